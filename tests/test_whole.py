"""Joins over all rows, against brute force."""

import collections

from haloforge.operators import tree as T
from haloforge.plans import queries
from haloforge.plans.standins import load, members
from haloforge.registry import QUERIES

from .conftest import DATA


def test_joins_take_all_rows(spark):
    nodes, halos = load(spark, DATA, "nodes").collect(), load(spark, DATA, "halos").collect()
    run = lambda name: QUERIES[name](spark, DATA).collect()
    by = {(n.tree_id, n.snapnum): n for n in nodes}
    want = sorted(by[n.tree_id, n.snapnum - 2].node_id for n in nodes if (n.tree_id, n.snapnum - 2) in by)
    assert sorted(r.node_id for r in run("node_lookup_all")) == want
    start, at = {}, 0
    for tree, size in sorted(collections.Counter(n.tree_id for n in nodes).items()):
        start[tree], at = at, at + size
    want = sorted((n.tree_id, n.node_id, start[n.tree_id], n.snapnum) for n in nodes)
    narrow = T.slices(load(spark, DATA, "nodes"), queries._trees(spark, DATA), 11, 7)  # ranges over many buckets
    for found in (run("tree_slice_all"), narrow.collect()):
        assert sorted((r.tree_id, r.node_id, r.start_offset, r.snapnum) for r in found) == want
    want = sorted((n.node_id, h.halo_id) for n in nodes for h in halos if abs(n.scale_factor - 1 / (1 + h.halo_id / 8)) < 1e-4)
    assert sorted((r.node_id, r.halo_id) for r in run("tolerance_match_all")) == want
    tree = {n.node_id: n.tree_id for n in nodes}
    assert any(tree[n] % 20 for n, _ in want)
    held = {r.pid for r in members(spark, DATA).collect()}
    assert sorted(r.pid for r in run("region_fof_all")) == sorted(p.pid for p in load(spark, DATA, "particles").select("pid").collect() if p.pid in held)


def test_add_gas_keeps_rows_whose_ids_repeat(spark):
    rows = load(spark, DATA, "particles").where("ptype <> 0").select("pid", "ptype").collect()
    dark = sum(r.ptype == 1 for r in rows)
    assert len({r.pid for r in rows}) < len(rows)
    found = queries.QUERIES["add_gas_particles"](spark, DATA).collect()
    assert sorted(r.pid for r in found if r.ptype == 0) == list(range(dark))
    assert sorted((r.pid, r.ptype) for r in found if r.ptype) == sorted((r.pid + dark, r.ptype) for r in rows)
