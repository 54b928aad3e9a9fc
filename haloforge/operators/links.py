"""Following pointers from row to row, for lists and branches of any length.

A path isn't walked node by node: jump pointers are doubled, so a path of n nodes takes log2(n) rounds, each a join of two written
tables.  Nothing needs a whole list or tree in one task, and a lost executor costs a round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloforge.work import drop_table, materialize


def follow(links: DataFrame, roots: DataFrame) -> DataFrame:
    """links (node, to), roots (node) -> root, depth (from 0 on), node: all nodes on the path from each root.

    Nodes are of any type that can be joined, structs too; each has one row.  A path ends where ``to`` is null, is no node, or is the
    node itself.  Roots that are no nodes have no path; repeated roots count once; paths may share nodes.  Paths that
    go round in a circle raise a ``ValueError``.
    """
    written = materialize(links.select("node", "to"), "links")
    nodes = written.select("node")
    jump = materialize(written.where("to is not null and to <> node").join(nodes.withColumnRenamed("node", "to"), "to", "left_semi").select("node", "to"), "jumps")
    parts = [materialize(nodes.join(roots.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), "node"), "paths")]
    most, step = jump.count(), 1
    while True:
        # What is known reaches to depth step - 1; a jump is of ``step``.
        found = reduce(DataFrame.union, parts)
        ahead = materialize(found.join(jump, "node").select("root", (F.col("depth") + step).alias("depth"), F.col("to").alias("node")), "paths")
        if ahead.isEmpty():
            drop_table(ahead)
            break
        if step > most:
            raise ValueError("pointers go round in a circle")
        parts.append(ahead)
        further = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        before, jump = jump, materialize(jump.join(further, "to").select("node", F.col("to2").alias("to")), "jumps")
        drop_table(before)
        step *= 2
    drop_table(jump)
    drop_table(written)
    return reduce(DataFrame.union, parts)
