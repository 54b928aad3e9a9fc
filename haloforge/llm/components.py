"""Connected components over distributed edges: alternating large and small stars (Kiveris et al., 2014).

Only built-in functions.  Each round leaves at most as many edges as it had, and few rounds are needed: about the
square of the logarithm of a component's size.  Least neighbours are aggregated before they are shuffled, and joined
again as written tables, so adaptive execution can split the edges of a node with very many neighbours.  Tables of a
round are deleted when the next is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloforge.llm.store import drop_table, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _ordered(edges: DataFrame) -> DataFrame:
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    return now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _star(now: DataFrame) -> DataFrame:
    """One large and one small star: (u, v), v < u, with the same components and shorter ways."""
    both = now.union(now.select("v", "u"))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    large = materialize(large.distinct(), "large")
    small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
    small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    out = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    for old in (now, least, large, small_least):
        drop_table(old)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any one ordered type -> (node, label): the smallest node of its component, for each node that
    has an edge to another.  Nulls and loops are left out; repeated edges count once; no edges give no rows."""
    now = materialize(_ordered(edges).distinct(), "edges")
    before = _mark(now)
    while before[0]:
        now = _star(now)
        after = _mark(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
