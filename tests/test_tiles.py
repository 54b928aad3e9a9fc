"""The filter in tiles against passes over the whole dense grid."""

import numpy as np
import pytest

from haloforge.operators import grid


def dense(cells, sigma, boundary):
    weights = np.array([w for _, w in grid.kernel(sigma)])
    reach = len(weights) // 2
    for axis in range(3):
        wide = [(0, 0)] * 3
        wide[axis] = (reach, reach)
        padded = np.pad(cells, wide, mode="symmetric" if boundary == "reflect" else "wrap")
        cells = sum(w * np.take(padded, range(k, k + cells.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return cells


@pytest.mark.parametrize("boundary", ["reflect", "wrap"])
@pytest.mark.parametrize("shape, sigma, tile", [((16, 16, 16), 1.0, None), ((13, 7, 10), 0.8, 4), ((9, 5, 3), 1.3, 3), ((3, 2, 1), 1.0, 2)])
def test_filter_in_tiles(spark, boundary, shape, sigma, tile):
    """Tiles that don't divide the grid, and kernels wider than it."""
    r = np.random.default_rng(8)
    cells = np.where(r.random(shape) < 0.2, r.normal(size=shape), 0.0)
    cells[0, 0, 0] = 5.0
    at = np.argwhere(cells != 0)
    rows = spark.createDataFrame([(*map(int, x), float(cells[tuple(x)])) for x in at], "ix int, iy int, iz int, value double")
    found = grid.gaussian_filter(rows, shape, sigma, boundary, tile).collect()
    want, near = dense(cells, sigma, boundary), dense((cells != 0).astype(float), sigma, boundary) > 1e-300
    assert {(x.ix, x.iy, x.iz) for x in found} == set(map(tuple, np.argwhere(near).tolist())) and len(found) == near.sum()
    assert max(abs(x.value - want[x.ix, x.iy, x.iz]) for x in found) < 1e-12


def test_filter_of_nothing(spark):
    none = spark.createDataFrame([], "ix int, iy int, iz int, value double")
    assert grid.gaussian_filter(none, (8, 8, 8)).count() == 0
    plan = grid.gaussian_filter(none.union(none), (8, 8, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    with pytest.raises(ValueError):
        grid.gaussian_filter(none, (8, 8, 8), boundary="cut")
