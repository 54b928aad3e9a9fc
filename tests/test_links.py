"""Paths along pointers against a plain walk, and what stands on them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haloforge.operators import tree
from haloforge.operators.links import follow
from haloforge.sources import hdf5

from . import stand_in_hdf5
from .stand_in_hdf5 import group, make


def walked(to, roots):
    out = set()
    for r in roots:
        if r not in to:
            continue
        k, d = r, 0
        while True:
            out.add((r, d, k))
            if to[k] is None or to[k] == k or to[k] not in to:
                break
            k, d = to[k], d + 1
    return out


def found_of(spark, to, roots):
    links = spark.createDataFrame(list(to.items()), "node long, to long")
    found = follow(links, spark.createDataFrame([(r,) for r in roots], "node long")).collect()
    assert len(found) == len(set(map(tuple, found)))
    return {tuple(r) for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_as_walked(spark, seed):
    """Paths that join, end in no node, in themselves and in null; roots that are no nodes or repeat."""
    r = random.Random(seed)
    to = {k: r.choice([None, k, 900 + k, *range(max(0, k - 4), k)]) for k in range(70)}
    roots = [r.randrange(80) for _ in range(30)]
    assert found_of(spark, to, roots) == walked(to, roots)


def test_long_paths_and_circles(spark):
    to = {k: k + 1 for k in range(200)} | {200: None}
    assert found_of(spark, to, [0, 150]) == walked(to, [0, 150])
    assert found_of(spark, to, []) == set() and found_of(spark, {5: None}, [5]) == {(5, 0, 5)}
    for circle in ({0: 1, 1: 2, 2: 0}, {0: 1, 1: 2, 2: 1}):
        with pytest.raises(ValueError, match="circle"):
            found_of(spark, circle, [0])
    with pytest.raises(ValueError, match="circle"):
        tree.link_chains(spark.createDataFrame([(1, 0, 2), (2, 0, 3), (3, 0, 1), (8, 0, 9)], "desc_id long, prog_rank int, prog_id long"))


NODES = "tree_id long, node_id long, snapnum int, main_prog long, mass double"


@pytest.mark.parametrize("terminal", [True, False])
def test_large_trees_as_small_ones(spark, terminal):
    """Trees beyond the size for a task, and those within it, have the branches that a walk has."""
    r = random.Random(3)
    rows = []
    for t in range(6):
        n = r.choice([1, 3, 40])
        rows += [(t, k, 60 - k, r.choice([-1, None, 999, k, *range(k + 1, min(k + 3, n))]), float(k)) for k in range(n)]
    nodes = spark.createDataFrame(rows, NODES)
    each = [{tuple(x) for x in tree.branches(nodes, include_terminal=terminal, tree_rows=most).collect()} for most in (1000, 10, 0)]
    assert each[0] == each[1] == each[2] and len(each[0]) > 30
    with pytest.raises(ValueError, match="tree_id"):
        tree.branches(nodes.withColumn("tree_id", F.lit(None).cast("long"))).count()
    with pytest.raises(ValueError, match="circle"):
        tree.branches(spark.createDataFrame([(1, 1, 5, 2, 1.0), (1, 2, 4, 1, 1.0)], NODES), spark.createDataFrame([(1, 1)], "tree_id long, node_id long"), tree_rows=0)


def test_tree_of_a_million_nodes(spark):
    """One tree, split over tasks: a thousand branches of a thousand nodes each."""
    k = F.col("id")
    nodes = spark.range(1_000_000, numPartitions=4).select(F.lit(7).cast("long").alias("tree_id"), k.alias("node_id"), (1000 - k % 1000).cast("int").alias("snapnum"), F.when(k % 1000 == 999, -1).otherwise(k + 1).alias("main_prog"))
    found = tree.branches(nodes, nodes.where("node_id % 250000 = 0"), tree_rows=100_000)
    assert "MapInPandas" not in tree._followed(nodes.limit(5).withColumns({"__root": F.lit(True), "__to": F.col("main_prog")}), True)._jdf.queryExecution().toString()
    got = found.groupBy("root_id").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max(F.col("node_id") - F.col("root_id")).alias("last")).collect()
    assert sorted(map(tuple, got)) == [(250_000 * j, 999, 998, 998) for j in range(4)]


def test_treefrog_file_to_branches(spark, tmp_path, monkeypatch):
    """From the reader's rows, without tree ids: ids repeat between snapshots, a progenitor may be two snapshots back, one halo's tail
    is before its last node, one lies in another halo, and a first node is its own progenitor."""
    monkeypatch.setattr(hdf5, "_h5py", lambda: stand_in_hdf5)

    def snap(k, rows):
        ids, prog, prog_snap, tail, host = (list(x) for x in zip(*rows, strict=True))
        n, one = len(rows), [1.0] * len(rows)
        return group({"Snapnum": k, "scalefactor": 0.25 * (k + 1), "NHalos": n}, ID=ids, Progenitor=prog, ProgenitorSnap=prog_snap, RootTailSnap=tail, RootHead=[5] * n, RootTail=ids, RootHeadSnap=[3] * n, hostHaloID=host, Mass_tot=[float(10 * k + i) for i in ids], Mass_200crit=one, Mass_FOF=[4.0] * n, Xcminpot=one, Ycminpot=one, Zcminpot=one, VXc=one, VYc=one, VZc=one, sigV=one, Vmax=one, Rmax=one)

    snaps = {"Snap_000": snap(0, [(1, 1, 0, 0, -1), (2, 2, 0, 0, -1)]), "Snap_001": snap(1, [(1, 1, 0, 0, -1), (3, 3, 1, 1, -1)]), "Snap_002": snap(2, [(1, 2, 0, 0, -1), (2, 1, 1, 0, -1)]), "Snap_003": snap(3, [(5, 2, 2, 0, -1), (6, 1, 2, 1, -1), (7, 3, 1, 1, 5)])}
    path = make(tmp_path / "frog.hdf5", Header=group({"NSnaps": 4}, TreeBuilder=group({"Temporal_halo_id_value": 1000}), Simulation=group({"h_val": 0.7})), **snaps).removesuffix(".hdf5")
    source = hdf5.Hdf5Source({"path": path, "entity": "tree_nodes", "convention": "TREEFROG"})
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(source.schema())
    reader = source.reader(schema)
    rows = [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    nodes = spark.createDataFrame(rows, schema)
    first = nodes.where("node_id = 5 and snapnum = 3").first()
    assert (first.root_head, first.root_tail, first.root_head_snap, first.mfof) == (5, 5, 3, 4.0) and first.tree_id is None
    found = sorted((r.root_snap, r.root_id, r.depth, r.snapnum, r.node_id) for r in tree.branches_by_snapshot(nodes).collect())
    # Halo 6 at 3 has its tail at 1, so the node at 0 isn't on its branch; 7 lies in 5; 3 at 1 is led to by 7.
    assert found == [(3, 5, 0, 3, 5), (3, 5, 1, 2, 2), (3, 5, 2, 1, 1), (3, 6, 0, 3, 6), (3, 6, 1, 2, 1)]
    given = spark.createDataFrame([(2, 2), (3, 7)], "snapnum int, node_id long")
    assert sorted((r.root_snap, r.root_id, r.depth, r.node_id) for r in tree.branches_by_snapshot(nodes, given).collect()) == [(2, 2, 0, 2), (2, 2, 1, 1)]


def test_lists_that_are_not_in_order(spark):
    """FOF and sibling lists follow their pointers, whatever the ids are."""
    fof = "tree_id long, node_id long, snapnum int, first_in_fof long, next_in_fof long, main_prog long, next_prog long"
    rows = [(1, 9, 60, 9, 3, 8, -1), (1, 3, 60, 9, 7, -1, -1), (1, 7, 60, 9, -1, 6, -1), (1, 8, 59, 8, -1, -1, 2), (1, 2, 59, 2, -1, -1, 4), (1, 4, 58, 4, -1, -1, -1), (1, 6, 59, 6, -1, -1, -1), (2, 9, 60, 9, -1, -1, -1)]
    nodes = spark.createDataFrame(rows, fof)
    got = sorted((r.tree_id, r.first_in_fof, r["rank"], r.node_id, r["last"]) for r in tree.fof_members(nodes, 60).collect())
    assert got == [(1, 9, 0, 9, False), (1, 9, 1, 3, False), (1, 9, 2, 7, True), (2, 9, 0, 9, True)]
    edges = sorted((r.src, r.dst, r.src_snap, r.dst_snap, round(r.x, 3)) for r in tree.tree_edges(nodes, min_snap=55).collect())
    assert edges == [(7, 6, 60, 59, 0.0), (9, 2, 60, 59, 0.1), (9, 4, 60, 58, 0.2), (9, 8, 60, 59, 0.0)]


def test_next_places():
    r = np.random.default_rng(2)
    trees, node = r.integers(0, 4, 60), np.arange(60) % 15
    to = r.integers(-1, 18, 60)
    both = list(zip(trees.tolist(), node.tolist(), strict=True))
    keep = sorted({k: i for i, k in reversed(list(enumerate(both)))}.values())
    trees, node, to = trees[keep], node[keep], to[keep]
    place = {k: i for i, k in enumerate(zip(trees.tolist(), node.tolist(), strict=True))}
    assert tree._next_places(trees, node, to).tolist() == [place.get((t, p), -1) for t, p in zip(trees.tolist(), to.tolist(), strict=True)]
