"""Corpus operators for training data: packing, near-dedup, token files, decontamination, quality,
URL rules, line dedup, toxicity, personal data and substring dedup.  Nothing else in the library imports this."""
