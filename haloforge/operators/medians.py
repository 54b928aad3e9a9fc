"""Exact medians of a few groups, however many rows each has.

A sketch isn't exact, and an aggregate that is exact brings all distinct values of a group to one task.  Here the
interval that holds the middle rank is cut into equal cells, rows are counted by cell, partially before they are shuffled, and the cell
with the rank becomes the next interval, from its least to its greatest value, until all its values are equal.  A
pass leaves about one row in ``CELLS``, so 10**12 rows take four or so; what meets in one place is a row a cell at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloforge.work import drop_table, materialize

CELLS = 4096
_TARGET = "grp long, var string, first_rank long, rank long, whole boolean, low double, high double"


def _cell() -> Column:
    """The value's place in the target's interval; infinities and NaN, which is greatest, have places of their own."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    width = high / 2 - low / 2  # the difference itself may be beyond all doubles
    inside = F.when(width > 0, F.least(F.floor((v / 2 - low / 2) / width * CELLS), F.lit(CELLS - 1))).otherwise((v > low).cast("long"))
    return F.when(F.isnan(v), CELLS + 1).when(v == float("inf"), CELLS).when(v == float("-inf"), -1).otherwise(inside)


def medians(rows: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """``group`` and, under the values' names, their medians: one row for each group (an integer) that has a value.

    Nulls are no values; a value that is NaN is greater than any other; of an even number, the mean of the middle two.  Groups and
    values are few: there is a driver's row for each two of them.  ``rows`` is written once, narrowed to groups and values.
    """
    spark = rows.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(f"`{c}`").cast("double").alias("v")) for c in values]))
    named = rows.select(F.col(f"`{group}`").cast("long").alias("grp"), each.alias("x")).select("grp", "x.var", "x.v")
    # No filter before the table is written: Spark would write the groups' whole expressions out in it once more.
    written = materialize(named, "values")
    long = written.where("grp is not null and v is not null")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    sizes = long.groupBy("grp", "var").agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")).collect()
    # A target's rank counts within its interval; its first rank, within the group, tells two of one value apart.
    targets = [(r.grp, r["var"], rank, rank, True, r.low, r.high) for r in sizes for rank in sorted({(r.n - 1) // 2, r.n // 2})]
    at: dict[tuple, float] = {}  # (group, value, rank in the group) -> value
    while targets:
        wanted = spark.createDataFrame(targets, _TARGET)
        met = long.join(F.broadcast(wanted), ["grp", "var"]).where("whole or (v >= low and v <= high)")
        key = ["grp", "var", "first_rank", "rank"]
        counts = met.groupBy(*key, _cell().alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("cell"))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).collect()
        targets = []
        for r in found:
            if r.low == r.high or r.low != r.low or r.n == 1:
                at[r.grp, r["var"], r.first_rank] = r.low
            else:
                targets.append((r.grp, r["var"], r.first_rank, r["rank"] - (r.upto - r.n), False, r.low, r.high))
    drop_table(written)
    middle: dict[int, dict[str, float]] = {}
    for r in sizes:
        a, b = at[r.grp, r["var"], (r.n - 1) // 2], at[r.grp, r["var"], r.n // 2]
        middle.setdefault(r.grp, {})[r["var"]] = a if a == b or r.n % 2 else 0.5 * a + 0.5 * b
    schema = ", ".join([f"`{group}` long", *[f"`{c}` double" for c in values]])
    return spark.createDataFrame([(g, *[m.get(c) for c in values]) for g, m in sorted(middle.items())], schema)
