"""Walks over trees move nodes once, and only the columns that are asked for; repeated ids and odd pointers give what they gave."""

import pytest
from pyspark.sql import functions as F

from haloforge.operators import tree
from haloforge.plans import queries

from .conftest import DATA

NODES = "tree_id long, node_id long, main_prog long, mass double"
#: Tree 1: 5 -> 4 -> 3, 9 -> 4, 8 to itself, 7 to no node.  Tree 2: the same ids, other pointers.  Tree 3: id 6 twice, led to by 7.
ROWS = [
    (1, 5, 4, 0.5), (1, 4, 3, 0.4), (1, 3, -1, 0.3), (1, 9, 4, 0.9), (1, 8, 8, 0.8), (1, 7, 77, 0.7),
    (2, 3, 5, 1.3), (2, 5, None, 1.5), (3, 7, 6, 2.7), (3, 6, 2, 2.6), (3, 6, 2, 2.6), (3, 2, -1, 2.2),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def nodes(spark, tmp_path):
    spark.createDataFrame(ROWS, NODES).write.parquet(str(tmp_path / "nodes"))
    return spark.read.schema(NODES).parquet(str(tmp_path / "nodes"))


def branch_rows(df):
    return sorted((r.tree_id, r.root_id, r.depth, r.node_id) for r in df.collect())


@pytest.mark.parametrize("most", [1000, 5])
def test_heads_are_found_in_the_walk(nodes, most):
    found = tree.branches(nodes, include_terminal=True, tree_rows=most)
    if most == 1000:
        assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
        want = [(1, 5, 0, 5), (1, 5, 1, 4), (1, 5, 2, 3), (1, 7, 0, 7), (1, 9, 0, 9), (1, 9, 1, 4), (1, 9, 2, 3), (2, 3, 0, 3), (2, 3, 1, 5), (3, 7, 0, 7), (3, 7, 1, 6), (3, 7, 2, 2)]
        assert branch_rows(found) == want
    else:  # tree 1 is followed across tasks
        assert [x for x in branch_rows(found) if x[0] == 1] == [(1, 5, 0, 5), (1, 5, 1, 4), (1, 5, 2, 3), (1, 7, 0, 7), (1, 9, 0, 9), (1, 9, 1, 4), (1, 9, 2, 3)]


def test_given_roots_come_with_the_exchange_of_the_walk(spark, nodes):
    roots = spark.createDataFrame([(1, 4), (1, 4), (1, 8), (1, 70), (2, 4), (3, 6), (None, 5), (2, None)], "tree_id long, node_id long")
    found = tree.branches(nodes, roots, include_terminal=True)
    assert plan(found).count("Exchange hashpartitioning(tree_id#") == 2 and "Join" not in plan(found)  # of distinct roots, and of all
    # A root given twice counts once; one that is there twice has two branches.
    want = [(1, 4, 0, 4), (1, 4, 1, 3), (1, 8, 0, 8), (3, 6, 0, 6), (3, 6, 0, 6), (3, 6, 1, 2), (3, 6, 1, 2)]
    assert branch_rows(found) == want and branch_rows(tree.branches(nodes, roots, include_terminal=True, tree_rows=5)) == want  # tree 1 across tasks


def test_no_nodes_and_no_roots(nodes):
    none = nodes.where("tree_id > 5")
    assert tree.branches(none).count() == 0 and tree.branches(nodes, none).count() == 0 and tree.branches(none, nodes).count() == 0


def test_tree_edges_write_what_they_use(spark, monkeypatch):
    written, write = {}, tree.materialize

    def noted(df, name):
        written.setdefault(name, df.columns)
        return write(df, name)

    monkeypatch.setattr(tree, "materialize", noted)
    found = tree.tree_edges(queries._fof(spark, DATA), min_snap=55)
    assert written["nodes"] == ["tree_id", "node_id", "snapnum", "main_prog", "next_prog"]
    assert found.columns == ["tree_id", "src", "dst", "src_snap", "dst_snap", "x"] and found.where("x > 0").count() > 0


def test_tree_edges_of_repeated_nodes(spark):
    rows = [(1, 10, 60, 11, -1), (1, 11, 59, -1, 12), (1, 11, 59, -1, 12), (1, 12, 59, -1, -1)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, snapnum int, main_prog long, next_prog long")
    found = sorted((r.src, r.dst, r.dst_snap, round(r.x, 3)) for r in tree.tree_edges(nodes).collect())
    assert found == [(10, 11, 59, 0.0)] * 2 + [(10, 12, 59, 0.1)] * 4


def test_orbit_radius_reads_its_nodes_written_once(spark, monkeypatch):
    written, write = [], queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, name: written.append(df) or write(df, name))
    found = queries.QUERIES["orbit_radius"](spark, DATA)
    assert len(written) == 1 and not {"m200", "redshift", "member"} & set(written[0].columns)
    assert not any("orders" in f for f in found.inputFiles())


def test_lists_of_fof_groups_are_written_once(spark):
    members = tree.fof_members(queries._fof(spark, DATA))
    assert not any("orders" in f for f in members.inputFiles())
    assert members.groupBy("tree_id", "first_in_fof").agg(F.count_if("last").alias("n")).where("n <> 1").isEmpty()
