"""Hand-computed cases, invariants and NumPy twins."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haloforge.cosmology import SimHeader
from haloforge.functions import columns
from haloforge.functions.columns import digitize, linear_edges, log_edges, safe_log10, wrap
from haloforge.operators import grid, profiles, selection, spatial, transform, tree


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def points(spark, rows):
    return frame(spark, [tuple(map(float, r)) for r in rows], "x double, y double, z double")


def test_wrap(spark):
    found = frame(spark, [(6.0,), (-6.0,), (5.0,), (-5.0,), (16.0,)], "d double").select(wrap(F.col("d"), 10.0)).collect()
    assert [r[0] for r in found] == [-4.0, 4.0, 5.0, -5.0, 6.0]


def test_cubic_borders_are_out(spark):
    p = points(spark, [(0.999, 0, 0), (1.0, 0, 0)])
    assert selection.select_particles(p, (0, 0, 0), 2.0).count() == 1
    assert selection.select_particles(p, (0, 0, 0), 1.0, "spherical").count() == 1
    assert selection.particles_in_region(p, (0, 0, 0), 0.2).count() == 2  # borders are in
    with pytest.raises(ValueError):
        selection.select_particles(p, (0, 0, 0), 1.0, "round")
    with pytest.raises(ValueError):
        selection.particles_in_region(p, region="FOF")


def test_digitize(spark):
    found = frame(spark, [(v,) for v in (0.5, 1.0, 9.99, 10.0, 99.0, 100.0)], "r double").select(digitize(F.col("r"), [1.0, 10.0, 100.0])).collect()
    assert [r[0] for r in found] == [0, 1, 1, 2, 2, 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e3), min_size=1, max_size=50), st.integers(1, 12))
def test_digitize_as_numpy(spark, values, n):
    for edges in (log_edges(0.5, 300.0, n), linear_edges(0.5, 300.0, n)):
        found = frame(spark, [(v,) for v in values], "r double").select(digitize(F.col("r"), edges).alias("b")).toPandas()
        assert found.b.tolist() == np.digitize(values, edges).tolist()


def test_radial_profile(spark):
    rows = frame(spark, [(v, 1.0, b) for v, b in zip((0.5, 1.0, 9.99, 10.0, 99.0, 100.0), (0, 1, 1, 2, 2, 3), strict=True)], "r double, mass double, bin int")
    found = profiles.radial_profile(rows, [1.0, 10.0, 100.0]).orderBy("bin").toPandas()
    assert np.allclose(found.r_mean, [0.5, 5.495, 54.5]) and np.allclose(found["median"], 1.0)
    assert np.allclose(found.density, [0.0, 4.7794277e-4, 4.7794277e-7])
    fixed = profiles.radial_profile(rows, [1.0, 10.0, 100.0], corrected=True).orderBy("bin").toPandas()
    assert math.isclose(fixed.density[0], 3 / (4 * math.pi))
    empty = profiles.radial_profile(rows.where("bin <> 1"), [1.0, 10.0, 100.0]).orderBy("bin").toPandas()
    assert math.isnan(empty.r_mean[1]) and empty.density[1] == 0 and math.isnan(empty["median"][1])


def test_safe_log(spark):
    found = frame(spark, [(0.0,), (-1.0,), (100.0,)], "v double").select(safe_log10(F.col("v"))).collect()
    assert found[0][0] == float("-inf") and math.isnan(found[1][0]) and found[2][0] == 2.0


def test_cic_single(spark):
    p = frame(spark, [(0.25, 0.5, 3.75, 8.0)], "x double, y double, z double, m double")
    found = {(r.ix, r.iy, r.iz): r.value for r in grid.cic(p, "m", (4, 4, 4), (0, 4, 0, 4, 0, 4)).collect()}
    assert found == {(0, 0, 3): 0.75, (1, 0, 3): 0.25, (0, 1, 3): 0.75, (1, 1, 3): 0.25, (0, 0, 0): 2.25, (1, 0, 0): 0.75, (0, 1, 0): 2.25, (1, 1, 0): 0.75}


def test_kernel():
    assert np.allclose([w for o, w in grid.kernel(1.0) if o >= 0], [0.39894347, 0.24197145, 0.05399113, 0.00443186, 0.00013383])


@pytest.mark.parametrize("boundary", ["reflect", "wrap"])
def test_gaussian_as_numpy(spark, boundary):
    rng = np.random.default_rng(1)
    cells = rng.random((5, 6, 7))
    want = cells
    for axis in range(3):
        padded = np.pad(want, [(12, 12) if a == axis else (0, 0) for a in range(3)], mode="symmetric" if boundary == "reflect" else "wrap")
        want = sum(w * np.take(padded, np.arange(want.shape[axis]) + 12 + o, axis=axis) for o, w in grid.kernel(2.0))
    rows = [(i[0], i[1], i[2], float(v)) for i, v in np.ndenumerate(cells)]
    found = grid.gaussian_filter(frame(spark, rows, "ix int, iy int, iz int, value double"), cells.shape, 2.0, boundary).collect()
    got = np.zeros(cells.shape)
    for r in found:
        got[r.ix, r.iy, r.iz] = r.value
    assert np.allclose(got, want) and math.isclose(got.sum(), cells.sum())


def test_slabs(spark):
    g = frame(spark, [(0, 0, k, 1.0) for k in range(8)], "ix int, iy int, iz int, value double")
    total = lambda **k: grid.grid_slice(g, (1, 1, 8), "z", average=False, **k).first().value
    assert [total(), total(width=2), total(width=3), total(index=0, width=3)] == [1, 3, 3, 2]
    assert grid.grid_projection(g, (1, 1, 8), "z", "mean").first().value == 1.0
    with pytest.raises(ValueError):
        grid.grid_slice(g, (1, 1, 8), "w")
    with pytest.raises(ValueError):
        grid.ngp(g, "value", (2, 2), (0, 1, 0, 1))


def test_ngp_outside(spark):
    p = frame(spark, [(-0.5, 0.0, 0.0, 1.0), (3.5, 0.0, 0.0, 2.0)], "x double, y double, z double, m double")
    limits = (0, 4, 0, 4, 0, 4)
    assert grid.ngp(p, "m", (4, 4, 4), limits).first().value == 2.0
    assert grid.ngp(p, "m", (4, 4, 4), limits, periodic=True).first().value == 3.0
    assert grid.smooth_to_grid(p, "m", (4, 4, 4), limits, "other").count() == 0


def test_mesh(spark):
    p = points(spark, [(-10, 0, 99), (100, 0, 0)])
    found = transform.mesh_cells(p, (0, 0, 0), 100.0, 8).collect()
    assert [(r.cx, r.cy, r.cz) for r in found] == [(0, 0, 7), (8, 0, 0)]


def test_units_round_trip(spark):
    p = frame(spark, [(1.0, 2.0, 3.0, 4.0)], "x double, y double, z double, mass double")
    h = SimHeader(scale_factor=0.25, hubble=0.7)
    assert transform.convert_units(p, h, to_physical=True, to_comoving=True).collect() == p.collect()
    r = transform.convert_units(p, h, per_littleh=True).first()
    assert math.isclose(r.mass, 2.8) and math.isclose(r.x, 0.7)


def test_gas_split(spark):
    h = SimHeader(omega0=0.1964)
    p = frame(spark, [(k, 100 + k, 1, 1.0, 1.0, 1.0, 0.1964 * 27.755) for k in range(3)] + [(3, 103, 4, 1.0, 1.0, 1.0, 1.0)], "row_id long, pid long, ptype int, x double, y double, z double, mass double")
    found = transform.add_gas(p, h).orderBy("ptype", "pid").toPandas()
    gas, dark, star = (found[found.ptype == t] for t in (0, 1, 4))
    assert np.allclose(gas.x, 1 - 0.1875) and np.allclose(dark.x, 0.75) and gas.pid.tolist() == [0, 1, 2] and dark.pid.tolist() == [103, 104, 105]
    assert np.allclose(gas.mass, 0.25 * 0.1964 * 27.755) and np.allclose(dark.mass, 0.75 * 0.1964 * 27.755) and (gas.u == 100).all() and np.allclose(gas.hsml, 1.0)
    assert star.x.iloc[0] == 1.0 and star.pid.iloc[0] == 106


def test_mass_function(spark):
    halos = frame(spark, [(m,) for m in (1.0, 10.0, 100.0, 1000.0)], "m200 double")
    found = profiles.mass_function(halos, 10.0, n=3).orderBy("bin").toPandas()
    assert found.n.tolist() == [1, 1, 2] and np.allclose(found.log_mass, [10.5, 11.5, 12.5]) and np.allclose(found.log_density, [-3.47712, -3.47712, -3.17609], atol=1e-5)
    fixed = profiles.mass_function(halos, 10.0, n=3, corrected=True).orderBy("bin").toPandas()
    assert math.isclose(fixed.log_density[0], -3.0)
    assert profiles.mass_function(halos, 10.0, dlogm=1.0).count() == 3 and profiles.mass_function(halos.limit(0), 10.0).count() == 0


def test_histogram_as_numpy(spark):
    v = np.random.default_rng(2).normal(size=500)
    found = profiles.histogram(frame(spark, [(float(x),) for x in v], "v double"), "v", 13).orderBy("bin").toPandas()
    n, edges = np.histogram(v, 13)
    assert found.n.tolist() == n.tolist() and np.allclose(found.low, edges[:-1])
    assert profiles.histogram(frame(spark, [(2.0,)] * 3, "v double"), "v", 2).orderBy("bin").toPandas().n.tolist() == np.histogram([2.0] * 3, 2)[0].tolist()


@pytest.mark.parametrize("largest", [4.0, 30.0, 49.0])
def test_ball_join_as_brute_force(spark, largest):
    rng = np.random.default_rng(3)
    p, c = rng.random((400, 3)) * 100, rng.random((30, 3)) * 100
    r = rng.random(30) * largest
    d = np.abs(p[:, None, :] - c[None, :, :])
    d = np.minimum(d, 100 - d)
    want = {(i, j) for i, j in zip(*np.nonzero(np.sqrt((d**2).sum(-1)) < r[None, :]), strict=True)}
    ps = frame(spark, [(k, *map(float, x)) for k, x in enumerate(p)], "pid long, x double, y double, z double")
    cs = frame(spark, [(k, *map(float, x), float(r[k])) for k, x in enumerate(c)], "halo_id long, x double, y double, z double, r200 double")
    got = spatial.ball_join(ps, cs, 100.0).select("pid", "c_halo_id").collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == want
    assert spatial.ball_join(ps, cs.limit(0), 100.0).count() == 0


def test_ball_join_of_unlike_radii(spark):
    """One radius is 20 times the others: small balls keep small cells, and few pairs are made for each that is found."""
    rng = np.random.default_rng(4)
    p, c = rng.random((20_000, 3)) * 100, rng.random((200, 3)) * 100
    r = np.where(np.arange(200) == 7, 40.0, 2.0)
    d = np.abs(p[:, None, :] - c[None, :, :])
    d = np.minimum(d, 100 - d)
    want = (np.sqrt((d**2).sum(-1)) < r).sum(axis=0)
    ps = frame(spark, [(k, *map(float, x)) for k, x in enumerate(p)], "pid long, x double, y double, z double")
    cs = frame(spark, [(k, *map(float, x), float(r[k])) for k, x in enumerate(c)], "halo_id long, x double, y double, z double, r200 double")
    got = spatial.ball_join(ps, cs, 100.0)
    counts = dict(got.groupBy("c_halo_id").count().collect())
    assert [counts.get(k, 0) for k in range(200)] == want.tolist()
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_ball_join_outside_the_box_and_on_borders(spark):
    points = [(0, 0.0, 0.0, 0.0), (1, 99.999, 50.0, 50.0), (2, 100.0, 50.0, 50.0), (3, -0.5, 50.0, 50.0), (4, 50.0, 50.0, 50.0)]
    centres = [(0, 0.25, 50.0, 50.0, 1.0), (1, 99.9, 99.9, 99.9, 0.5), (2, 50.0, 50.0, 45.0, 5.0), (3, 1.0, 1.0, 1.0, None), (4, 1.0, 1.0, 1.0, 0.0)]
    ps, cs = frame(spark, points, "pid long, x double, y double, z double"), frame(spark, centres, "halo_id long, x double, y double, z double, r200 double")
    got = {(x.c_halo_id, x.pid) for x in spatial.ball_join(ps, cs, 100.0).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (1, 0)}


def test_digitize_as_numpy(spark):
    edges = [0.5, 1.0, 1.0, 2.5, 7.0]
    v = [-1.0, 0.5, 0.9, 1.0, 2.4999, 2.5, 7.0, 9.0, float("nan"), float("inf")]
    found = [r[0] for r in frame(spark, [(x,) for x in v], "v double").select(columns.digitize(F.col("v"), edges)).collect()]
    assert found == np.digitize(v, edges).tolist()


def test_apart_as_wrap(spark):
    v = [x for b in (-160.0, -100.0, -50.0, 0.0, 50.0, 100.0, 160.0) for x in (b - 1e-12, b, b + 1e-12, b + 0.1)]
    for r in frame(spark, [(x,) for x in v], "v double").select("v", F.abs(columns.wrap(F.col("v"), 100.0)).alias("a"), columns.apart(F.col("v"), 100.0).alias("b")).collect():
        assert r.a == r.b, r


def chain(spark, masses, zs):
    n = len(masses)
    rows = [(1, k, 60 - k, k + 1 if k + 1 < n else -1, float(masses[k]), float(zs[k])) for k in range(n)]
    return frame(spark, rows, "tree_id long, node_id long, snapnum int, main_prog long, m200 double, redshift double")


def test_branch(spark):
    nodes = chain(spark, [3, 2, 1], [0, 1, 2])
    assert tree.branches(nodes).orderBy("depth").toPandas().node_id.tolist() == [0, 1]
    assert tree.branches(nodes, include_terminal=True).count() == 3
    assert tree.branches(nodes, frame(spark, [(1, 1)], "tree_id long, node_id long")).toPandas().node_id.tolist() == [1]


def test_assembly(spark):
    k = np.arange(13)
    found = tree.assembly_statistics(tree.branches(chain(spark, np.maximum(1 - k / 12, 1e-9), 0.25 * k))).first()
    assert found.n_nodes == 12 and math.isclose(found.zform, 1.5) and math.isclose(found.alpha, 0.8283022166, rel_tol=1e-9) and math.isclose(found.dm_over_m, 0.1006413789, rel_tol=1e-9)
    few = tree.assembly_statistics(tree.branches(chain(spark, [2] * 11, range(11)))).first()
    assert (few.n_nodes, few.zform, few.alpha, few.dm_over_m) == (10, 0, 0, 0)


@pytest.mark.parametrize("most", [1000, 12, 0])
def test_assembly_while_walking(spark, most):
    """As of branches that are walked first; a tree beyond the size for a task, and one whose only node is its last."""
    r = np.random.default_rng(9)
    rows = [(t, 100 * t + k, 60 - k, 100 * t + k + 1 if k + 1 < n else -1, float(m), 0.25 * k) for t, n in enumerate((14, 1, 30, 12)) for k, m in enumerate(np.sort(r.random(n))[::-1] + 0.01)]
    nodes = frame(spark, rows, "tree_id long, node_id long, snapnum int, main_prog long, m200 double, redshift double")
    want = sorted(map(tuple, tree.assembly_statistics(tree.branches(nodes)).collect()))
    assert len(want) == 3 and sorted(map(tuple, tree.assembly_of_trees(nodes, tree_rows=most).collect())) == want
    assert tree.assembly_of_trees(nodes.limit(0)).count() == 0


def test_link_chains(spark):
    links = frame(spark, [(9, 0, 8), (8, 0, 7), (7, 0, 6), (9, 1, 3), (5, 0, 4)], "desc_id long, prog_rank int, prog_id long")
    found = {tuple(r) for r in tree.link_chains(links).collect()}
    assert found == {(9, 0, 9), (9, 1, 8), (9, 2, 7), (9, 3, 6), (5, 0, 5), (5, 1, 4)}


def test_running_sum(spark):
    rows = frame(spark, [(k * 7, k) for k in range(50)], "k long, v long")
    found = transform.running_sum(rows, "k", "v", "before", 20).orderBy("k").toPandas()
    assert found.before.tolist() == (np.cumsum(range(50)) - np.arange(50)).tolist()


def test_running_sum_of_sparse_and_crowded_keys(spark):
    rng = np.random.default_rng(7)
    keys = np.unique(np.concatenate([np.arange(1000), rng.integers(0, 1 << 60, 1000), [-(1 << 60)]])).tolist()
    rows = frame(spark, [(k, 1 + k % 5) for k in keys], "k long, v long").repartition(7)
    for ranges in (None, 1, 9):
        found = transform.running_sum(rows, "k", "v", "before", ranges).orderBy("k").toPandas()
        assert found.before.tolist() == [0, *np.cumsum([1 + k % 5 for k in keys]).tolist()[:-1]]
    assert transform.rank_from_zero(rows, "k", "rank").orderBy("k").toPandas()["rank"].tolist() == list(range(len(keys)))


def test_long_link_chains(spark):
    links = frame(spark, [(k, 0, k + 1) for k in range(100)], "desc_id long, prog_rank int, prog_id long")
    assert sorted(tuple(r) for r in tree.link_chains(links).collect()) == [(0, k, k) for k in range(101)]
    assert tree.link_chains(links.limit(0)).count() == 0


def test_members_explode(spark):
    halos = frame(spark, [(1, 0, 2), (2, 2, 0), (3, 2, 1)], "halo_id long, offset long, length long")
    pool = frame(spark, [(0, 10), (1, 11), (2, 12)], "position long, pid long")
    assert {tuple(r) for r in selection.members_of(halos, pool).collect()} == {(1, 0, 10), (1, 1, 11), (3, 0, 12)}


def test_hexbin_counts_all(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(pd.DataFrame(rng.random((300, 2)), columns=["a", "b"]))
    assert profiles.hexbin(rows, "a", "b", 8).agg(F.sum("n")).first()[0] == 300
