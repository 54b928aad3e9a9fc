"""Stand-in entities, the registered queries, and their SQL."""
