"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read again as the
next stage's docs.  All stages but the last return the columns of ``documents``.

Defined results: null texts are empty to all stages: scored by the bias alone, near copies of empty texts, and one piece, the end id alone;
texts without a word are near copies where they are equal; rows with a null doc_id or one that is no integer are scored, cut and packed as others are, take part in near-dedup with a
null id, and are never dropped as contaminated; repeated rows are near copies, of which one stays; columns besides those of
``documents`` are left out; without labels nothing is toxic, without benchmark items nothing is contaminated; empty documents give no
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haloforge.llm import decontam, linededup, nearcopies, packing, store, toxicity
from haloforge.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; labels of all rows may be learnt from but the held-out ones."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), learn_from=docs).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go; n_chars follows the text."""
    return linededup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return nearcopies.keep_one_of_each(docs.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path(), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity's training and packing aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            store.drop_table(before)
        before = docs
    return docs
