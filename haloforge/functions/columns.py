"""Column expressions shared by all operators.  Everything here is built-in and stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(d: Column, box: float | Column) -> Column:
    """Minimum image: one wrap by the box, at more than half of it.  Exactly half isn't wrapped."""
    half = box * 0.5
    return F.when(d > half, d - box).when(d < -half, d + box).otherwise(d)


def offsets(centre: Sequence[float | Column], box: float | Column | None = None, at: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    """The three offsets from a centre, wrapped if a box is given."""
    plain = [F.col(c) - v for c, v in zip(at, centre, strict=True)]
    return plain if box is None else [wrap(d, box) for d in plain]


def apart(d: Column, box: float | Column | None = None) -> Column:
    """The size of ``wrap(d, box)``, equal to the last bit; the offset stands in it twice only, so a filter's code stays short."""
    return F.abs(d) if box is None else F.least(F.abs(d), F.abs(F.abs(d) - box))


def norm2(d: Sequence[Column]) -> Column:
    x, y, z = d
    return x * x + y * y + z * z


def radius(d: Sequence[Column]) -> Column:
    return F.sqrt(norm2(d))


def log_edges(low: float, high: float, n: int) -> list[float]:
    a, b = math.log10(low), math.log10(high)
    return [10.0 ** (a + (b - a) * k / (n - 1)) if n > 1 else low for k in range(n)]


def linear_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / (n - 1) if n > 1 else low for k in range(n)]


def edges_of(limits: tuple[float, float], n: int, kind: str = "log") -> list[float]:
    return log_edges(*limits, n) if kind == "log" else linear_edges(*limits, n)


def digitize(r: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or below r: 0 before the first, len(edges) from the last on; NaN counts as beyond, null as before.

    A binary search in nested comparisons: unlike a filter over an array it is compiled, and unlike a logarithm it is
    exact at edges.
    """

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(r >= F.lit(float(edges[middle - 1])), search(middle, high)).otherwise(search(low, middle - 1))

    return search(0, len(edges))


def trunc0(v: Column) -> Column:
    """Towards zero, as a double."""
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """NaN where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))


def safe_log10(v: Column) -> Column:
    """-inf at 0 and NaN below it, where the built-in gives null."""
    return F.when(v > 0, F.log10(v)).when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan")))


def shell_volumes(edges: Sequence[float]) -> list[float]:
    """The ball of the first edge, then the shells between edges."""
    unit = 4.0 * math.pi / 3.0
    return [unit * edges[0] ** 3] + [unit * (b**3 - a**3) for a, b in zip(edges, edges[1:], strict=False)]
