"""Regular grids as sparse rows (ix, iy, iz, value); a cell without a row is 0."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("ix", "iy", "iz")
#: Cells of a tile along an axis.
TILE = 32


def _coordinates(particles: DataFrame, values: str | Column, shape: Sequence[int], limits: Sequence[float]) -> DataFrame:
    """gx, gy, gz: positions in units of cells, and v."""
    if len(shape) != 3 or len(limits) != 6:
        raise ValueError("grids have three axes: shape (nx, ny, nz), limits (x0, x1, y0, y1, z0, z1)")
    spacing = [(limits[2 * k + 1] - limits[2 * k]) / shape[k] for k in range(3)]
    at = [((F.col(c) - limits[2 * k]) / spacing[k]).alias(g) for k, (c, g) in enumerate(zip("xyz", ("gx", "gy", "gz"), strict=True))]
    return particles.select(*at, (F.col(values) if isinstance(values, str) else values).alias("v"))


def ngp(particles: DataFrame, values: str | Column, shape: Sequence[int], limits: Sequence[float], periodic: bool = False) -> DataFrame:
    """Nearest grid point: all of a value to the cell it lies in.  Rows outside are left out, or wrapped if periodic."""
    cells = _coordinates(particles, values, shape, limits).select(*[F.floor(g).alias(c) for g, c in zip(("gx", "gy", "gz"), CELL, strict=True)], "v")
    for c, n in zip(CELL, shape, strict=True):
        cells = cells.withColumn(c, F.pmod(F.col(c), F.lit(n))) if periodic else cells.where((F.col(c) >= 0) & (F.col(c) < n))
    return cells.groupBy(*[F.col(c).cast("int").alias(c) for c in CELL]).agg(F.sum("v").alias("value"))


def cic(particles: DataFrame, values: str | Column, shape: Sequence[int], limits: Sequence[float]) -> DataFrame:
    """Cloud in cell: a value is shared among eight cells, periodic at the borders.  Sums are made before the shuffle."""
    rows = _coordinates(particles, values, shape, limits)
    low = {g: F.floor(F.col(g)) for g in ("gx", "gy", "gz")}
    rows = rows.select("v", *[low[g].alias(f"{g}0") for g in low], *[(F.col(g) - low[g]).alias(f"{g}f") for g in low])
    corners = []
    for k in range(8):
        step = [k >> 2 & 1, k >> 1 & 1, k & 1]
        weight = F.col("v")
        for g, s in zip(low, step, strict=True):
            weight = weight * (F.col(f"{g}f") if s else 1.0 - F.col(f"{g}f"))
        corners.append(F.struct(*[F.pmod(F.col(f"{g}0") + s, F.lit(n)).cast("int").alias(c) for g, s, n, c in zip(low, step, shape, CELL, strict=True)], weight.alias("w")))
    each = rows.select(F.explode(F.array(*corners)).alias("c")).select("c.*")
    return each.groupBy(*CELL).agg(F.sum("w").alias("value"))


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian cut at ``truncate`` sigmas, weights summing to 1."""
    radius = int(truncate * sigma + 0.5)
    raw = [(o, math.exp(-0.5 * (o / sigma) ** 2)) for o in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(o, w / total) for o, w in raw]


def _images(at: Column, n: int, reach: int, boundary: str) -> Column:
    """All places from -reach to n + reach - 1 where a cell is seen, itself or by the boundary's rule."""
    turns = range(-(reach // n) - 1, reach // n + 2)
    seen = [at + m * n for m in turns] if boundary == "wrap" else [x for m in turns for x in (at + 2 * n * m, -1 - at + 2 * n * m)]
    return F.filter(F.array(*seen), lambda x: (x >= -reach) & (x < n + reach))


def _spread(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weighted neighbours along each axis in turn, of the inner cells."""
    for axis in range(3):
        n = cells.shape[axis] - len(weights) + 1
        out = np.zeros((*cells.shape[:axis], n, *cells.shape[axis + 1 :]))
        for k, w in enumerate(weights):
            out += w * np.take(cells, range(k, k + n), axis=axis)
        cells = out
    return cells


def _filter_tile(weights: list[float], shape: Sequence[int], size: int) -> Callable:
    """Rows (tile, place, value) of a tile and what is around it -> ix, iy, iz, value of the tile's cells that a row reaches."""
    reach = len(weights) // 2
    wide = size + 2 * reach

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        tiles = [-(-n // size) for n in shape]
        corner = [tile // (tiles[1] * tiles[2]) * size, tile // tiles[2] % tiles[1] * size, tile % tiles[2] * size]
        place, value = np.asarray(rows["place"]), np.asarray(rows["value"], dtype=np.float64)
        cells, there = np.zeros(wide**3), np.zeros(wide**3)
        np.add.at(cells, place, value)
        there[place] = 1.0
        found = _spread(cells.reshape(wide, wide, wide), np.array(weights))
        reached = _spread(there.reshape(wide, wide, wide), np.ones(len(weights))) > 0
        for axis in range(3):  # the last tile of an axis may be cut
            kept = [slice(None)] * 3
            kept[axis] = slice(0, shape[axis] - corner[axis])
            found, reached = found[tuple(kept)], reached[tuple(kept)]
        at = np.nonzero(reached)
        return pa.table({**{c: (x + o).astype(np.int32) for c, x, o in zip(CELL, at, corner, strict=True)}, "value": found[at]})

    return run


def gaussian_filter(grid: DataFrame, shape: Sequence[int], sigma: float = 1.0, boundary: str = "reflect", tile: int | None = None) -> DataFrame:
    """A pass an axis, in tiles of ``tile`` cells an axis.  ``reflect`` mirrors at the border (d c b a | a b c d | d c b a), ``wrap`` is
    periodic.  Cells that no row reaches have no row.

    A row goes to its tile and, where it is within the kernel's reach of others, to these: the only exchange there is.  In a task a
    tile is a dense array, and all three passes are array arithmetic.
    """
    if boundary not in ("reflect", "wrap"):
        raise ValueError("boundary is 'reflect' or 'wrap'")
    weights = [w for _, w in kernel(sigma)]
    reach = len(weights) // 2
    size = max(TILE, 2 * reach) if tile is None else tile
    wide, tiles = size + 2 * reach, [-(-n // size) for n in shape]
    rows = grid.select(*CELL, "value")
    for k, (c, n) in enumerate(zip(CELL, shape, strict=True)):
        rows = rows.withColumn(f"p{k}", F.explode(_images(F.col(c), n, reach, boundary)))
        low, high = F.greatest(F.floor((F.col(f"p{k}") - reach) / size), F.lit(0)), F.least(F.floor((F.col(f"p{k}") + reach) / size), F.lit(tiles[k] - 1))
        rows = rows.withColumn(f"t{k}", F.explode(F.sequence(low, high)))
    number = (F.col("t0") * tiles[1] + F.col("t1")) * tiles[2] + F.col("t2")
    inner = [(F.col(f"p{k}") - F.col(f"t{k}") * size + reach) for k in range(3)]
    placed = rows.select(number.alias("tile"), ((inner[0] * wide + inner[1]) * wide + inner[2]).cast("int").alias("place"), F.col("value").cast("double").alias("value"))
    return placed.groupBy("tile").applyInArrow(_filter_tile(weights, tuple(shape), size), "ix int, iy int, iz int, value double")


def smooth_to_grid(particles: DataFrame, values: str | Column, shape: Sequence[int], limits: Sequence[float], method: str = "NGP", sigma: float = 1.0, filter_sigma: float | None = None, boundary: str = "reflect") -> DataFrame:
    """NGP, CIC or GAUSSIAN (CIC, then a filter of width sigma), and one more filter if ``filter_sigma`` is given.  Another
    method gives an empty grid."""
    kind = method.upper()
    if kind == "NGP":
        grid = ngp(particles, values, shape, limits)
    elif kind in ("CIC", "GAUSSIAN"):
        grid = cic(particles, values, shape, limits)
    else:
        grid = particles.sparkSession.createDataFrame([], "ix int, iy int, iz int, value double")
    if kind == "GAUSSIAN":
        grid = gaussian_filter(grid, shape, sigma, boundary)
    return gaussian_filter(grid, shape, filter_sigma, boundary) if filter_sigma is not None else grid


def _planes(grid: DataFrame, shape: Sequence[int], axis: str) -> tuple[list[str], int, DataFrame]:
    if axis not in ("x", "y", "z"):
        raise ValueError("slice_axis is 'x', 'y' or 'z'")
    k = "xyz".index(axis)
    keep = [c for c in CELL if c != CELL[k]]
    spine = grid.sparkSession.range(shape[CELL.index(keep[0])]).select(F.col("id").cast("int").alias(keep[0]))
    other = grid.sparkSession.range(shape[CELL.index(keep[1])]).select(F.col("id").cast("int").alias(keep[1]))
    return keep, shape[k], spine.crossJoin(F.broadcast(other))  # the image's own cells, no rows of data


def grid_slice(grid: DataFrame, shape: Sequence[int], axis: str = "z", index: int | None = None, width: int | None = None, average: bool = True) -> DataFrame:
    """(two cell columns, value): mean or sum over the slab from index - width // 2 to index + width // 2.

    By default the middle cell alone.  An even width so has one cell more; slabs are cut at the borders.
    """
    keep, n, spine = _planes(grid, shape, axis)
    index = n // 2 if index is None else index
    width = 1 if width is None else width
    first, last = max(index - width // 2, 0), min(index + width // 2 + 1, n)
    column = CELL["xyz".index(axis)]
    total = grid.where((F.col(column) >= first) & (F.col(column) < last)).groupBy(*keep).agg(F.sum("value").alias("s"))
    value = F.coalesce(F.col("s"), F.lit(0.0))
    return spine.join(total, keep, "left").select(*keep, (value / F.lit(float(last - first)) if average else value).alias("value"))


def grid_projection(grid: DataFrame, shape: Sequence[int], axis: str = "z", how: str = "mean") -> DataFrame:
    """(two cell columns, value): mean, sum or max along an axis, cells without a row counting as 0."""
    keep, n, spine = _planes(grid, shape, axis)
    found = grid.groupBy(*keep).agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.count("*").alias("k"))
    value = {
        "mean": F.coalesce(F.col("s"), F.lit(0.0)) / F.lit(float(n)),
        "sum": F.coalesce(F.col("s"), F.lit(0.0)),
        "max": F.when(F.coalesce(F.col("k"), F.lit(0)) < n, F.greatest(F.coalesce(F.col("m"), F.lit(0.0)), F.lit(0.0))).otherwise(F.col("m")),
    }
    if how not in value:
        raise ValueError("projection is 'mean', 'sum' or 'max'")
    return spine.join(found, keep, "left").select(*keep, value[how].alias("value"))


def three_planes(grid: DataFrame, shape: Sequence[int], mode: str = "slice", how: str = "mean", index: int | None = None, width: int | None = None, average: bool = True, corrected: bool = False) -> DataFrame:
    """plane (xy, xz, yz), i, j, value.  Slices are the middle cell's, as users of the method have it; ``corrected``
    honours index, width and average."""
    if mode not in ("slice", "projection"):
        raise ValueError("mode is 'slice' or 'projection'")
    parts = []
    for axis, plane in (("z", "xy"), ("y", "xz"), ("x", "yz")):
        if mode == "projection":
            part = grid_projection(grid, shape, axis, how)
        else:
            part = grid_slice(grid, shape, axis, index, width, average) if corrected else grid_slice(grid, shape, axis)
        a, b, _ = part.columns
        parts.append(part.select(F.lit(plane).alias("plane"), F.col(a).alias("i"), F.col(b).alias("j"), "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
