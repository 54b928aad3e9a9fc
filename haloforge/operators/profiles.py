"""Radial and kinematic profiles, histograms and mass functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloforge.functions.columns import digitize, edges_of, offsets, radius, safe_div, shell_volumes
from haloforge.operators.medians import medians
from haloforge.operators.selection import select_particles


def with_radius(particles: DataFrame, centre: Sequence[float] = (0.0, 0.0, 0.0), box: float | None = None) -> DataFrame:
    """With dx, dy, dz (wrapped if a box is given) and r."""
    d = offsets(centre, box)
    return particles.withColumns({"dx": d[0], "dy": d[1], "dz": d[2]}).withColumn("r", radius([F.col("dx"), F.col("dy"), F.col("dz")]))


def radial_bins(rows: DataFrame, limits: tuple[float, float], n: int, kind: str = "log") -> tuple[DataFrame, list[float]]:
    """With ``bin``, 0 to n, and the n edges."""
    edges = edges_of(limits, n, kind)
    return rows.withColumn("bin", digitize(F.col("r"), edges)), edges


def _spine(rows: DataFrame, n: int) -> DataFrame:
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))


def _within(value: str | Column, n: int) -> Column:
    """The value where the bin counts.  A filter would be carried down to the scan, with the whole way from positions to the bin written out in
    it again and again, more than the JVM compiles; the further bin has no row on the spine and goes."""
    return F.when(F.col("bin") < n, F.col(value) if isinstance(value, str) else value)


def _middles(rows: DataFrame, n: int, *values: str | Column) -> DataFrame:
    """bin, m0, m1, ...: exact medians of the values in bins 0 to n - 1."""
    own = rows.select(F.when(F.col("bin") < n, F.col("bin")).alias("bin"), *[_within(v, n).alias(f"m{k}") for k, v in enumerate(values)])
    return medians(own, "bin", [f"m{k}" for k in range(len(values))])


def _sums(rows: DataFrame, n: int, *values: str | Column) -> DataFrame:
    """bin, r_mean, s0, s1, ...: sums of the values by bin."""
    return rows.groupBy("bin").agg(F.avg("r").alias("r_mean"), *[F.sum(_within(v, n)).alias(f"s{k}") for k, v in enumerate(values)])


def radial_profile(rows: DataFrame, edges: Sequence[float], var: str | Column = "mass", corrected: bool = False, median: bool = True) -> DataFrame:
    """bin, r_mean, density, median of rows (r, bin), one row for each edge; what lies beyond the last is left out.

    density is the sum by the shell's volume.  In bin 0 it is 0, as users of the method have it; ``corrected`` fills
    it.  Empty bins have NaN, 0 and NaN.  Medians are exact, and take passes of their own over the values: without ``median`` they aren't
    there.
    """
    n, nan = len(edges), F.lit(float("nan"))
    volumes = F.array(*[F.lit(v) for v in shell_volumes(edges)])
    density = F.coalesce(F.col("s0"), F.lit(0.0)) / F.get(volumes, F.col("bin"))
    density = (density if corrected else F.when(F.col("bin") == 0, 0.0).otherwise(density)).alias("density")
    found = _spine(rows, n).join(F.broadcast(_sums(rows, n, var)), "bin", "left")
    if median:
        found = found.join(F.broadcast(_middles(rows, n, var)), "bin", "left")
    return found.select("bin", F.coalesce("r_mean", nan).alias("r_mean"), density, *([F.coalesce("m0", nan).alias("median")] if median else []))


def mass_density_profile(particles: DataFrame, centre: Sequence[float], size: float, box: float, limits: tuple[float, float], n: int, geometry: str = "spherical", average: bool = True, corrected: bool = False) -> DataFrame:
    """bin, r_mean and the density (or the median mass) about a centre, in a periodic box and logarithmic bins."""
    picked = with_radius(select_particles(particles, centre, size, geometry, True, box), centre, box)
    rows, edges = radial_bins(picked, limits, n)
    found = radial_profile(rows, edges, "mass", corrected, not average)
    return found.select("bin", "r_mean", F.col("density" if average else "median").alias("density" if average else "median_mass"))


def gas_profile(gas: DataFrame, centre: Sequence[float], box: float, limits: tuple[float, float], n: int, average: bool = True) -> DataFrame:
    """bin, r_mean and rho and u (summed by volume, or their exact medians) of chosen gas rows, in linear bins."""
    rows, edges = radial_bins(with_radius(gas, centre, box), limits, n, "linear")
    volumes, nan = F.array(*[F.lit(v) for v in shell_volumes(edges)]), F.lit(float("nan"))
    names = ("rho", "u")
    found = _spine(rows, n).join(F.broadcast(_sums(rows, n, *names)), "bin", "left")
    if average:
        picked = [F.when(F.col("bin") == 0, 0.0).otherwise(F.coalesce(f"s{k}", F.lit(0.0)) / F.get(volumes, F.col("bin"))).alias(v) for k, v in enumerate(names)]
    else:
        found = found.join(F.broadcast(_middles(rows, n, *names)), "bin", "left")
        picked = [F.coalesce(f"m{k}", nan).alias(v) for k, v in enumerate(names)]
    return found.select("bin", F.coalesce("r_mean", nan).alias("r_mean"), *picked)


def kinematic_bins(rows: DataFrame, n: int) -> DataFrame:
    """rows (dx, dy, dz, r, dvx, dvy, dvz, bin) -> bin, r_mean, vr_mean, sigma_r, sigma.  r = 0 gives NaN."""
    vr = safe_div(F.col("dx") * F.col("dvx") + F.col("dy") * F.col("dvy") + F.col("dz") * F.col("dvz"), F.col("r"))
    found = rows.withColumn("vr", vr).groupBy("bin").agg(
        F.avg("r").alias("r_mean"), F.avg("vr").alias("vr_mean"), F.stddev_pop("vr").alias("sigma_r"), F.sqrt(F.var_pop("dvx") + F.var_pop("dvy") + F.var_pop("dvz")).alias("sigma")
    )
    nan = F.lit(float("nan"))
    return _spine(rows, n).join(F.broadcast(found), "bin", "left").select("bin", *[F.coalesce(c, nan).alias(c) for c in ("r_mean", "vr_mean", "sigma_r", "sigma")])


def kinematic_profile(particles: DataFrame, centre: Sequence[float], velocity: Sequence[float], size: float, box: float, limits: tuple[float, float], n: int, kind: str = "log") -> DataFrame:
    picked = with_radius(select_particles(particles, centre, size, "spherical", True, box), centre, box)
    moving = picked.withColumns({f"d{c}": F.col(c) - v for c, v in zip(("vx", "vy", "vz"), velocity, strict=True)})
    return kinematic_bins(radial_bins(moving, limits, n, kind)[0], n)


def kinematic_profile_raw(rows: DataFrame, limits: tuple[float, float], n: int, kind: str = "log") -> DataFrame:
    """As ``kinematic_profile`` of rows (x, y, z, vx, vy, vz) that are centred already."""
    moving = with_radius(rows).withColumns({f"d{c}": F.col(c) for c in ("vx", "vy", "vz")})
    return kinematic_bins(radial_bins(moving, limits, n, kind)[0], n)


def histogram(rows: DataFrame, value: str | Column, n: int) -> DataFrame:
    """bin, low, high, n: n equal bins between the least and the greatest value, the last closed on both sides.  If all
    values are equal, they lie half a unit inside either border."""
    v = F.col(value) if isinstance(value, str) else value
    values = rows.select(v.cast("double").alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null").select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n
    # ``ends`` is one row.
    found = values.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spine = _spine(rows, n).crossJoin(F.broadcast(ends))
    return spine.join(found, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mass_function(halos: DataFrame, box: float, mass: str = "m200", dlogm: float = 0.0, n: int = 10, corrected: bool = False) -> DataFrame:
    """bin, log_mass, n, log_density: the number of halos a unit volume and dex, by log10 of the mass in Msun.

    With a width ``dlogm`` the number of bins follows from it.  Without, the width that counts is divided by is
    max(log m - min(log m) / n), as users of the method have it; ``corrected`` takes the bins' own width.
    """
    logs = halos.where(F.col(mass) > 0).select(F.log10(mass).alias("lm"))
    low, high = logs.agg(F.min("lm"), F.max("lm")).first()
    if low is None:
        return logs.sparkSession.createDataFrame([], "bin int, log_mass double, n long, log_density double")
    if dlogm > 0:
        n, width = max(int((high - low) / dlogm), 1), dlogm
    else:
        width = (high - low) / n if corrected else high - low / n
    found = histogram(logs, F.col("lm") + 10, n)
    density = F.when(F.col("n") > 0, F.log10(F.col("n") / F.lit(box**3) / F.lit(width))).otherwise(F.lit(float("-inf")))
    return found.select("bin", (0.5 * (F.col("low") + F.col("high"))).alias("log_mass"), "n", density.alias("log_density"))


def hexbin(rows: DataFrame, x: str, y: str, nx: int = 128) -> DataFrame:
    """cx, cy, n: counts of points in hexagons over the points' own extent, two lattices of nx by nx / sqrt 3."""
    ny = int(nx / 3**0.5)
    points = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ends = points.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")])
    wide = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}")).otherwise(1.0)
    p = points.crossJoin(F.broadcast(ends)).select(((F.col("x") - F.col("lox")) / wide("x") * nx).alias("u"), ((F.col("y") - F.col("loy")) / wide("y") * ny).alias("v"))
    p = p.withColumns({"u1": F.floor(F.col("u") + 0.5), "v1": F.floor(F.col("v") + 0.5), "u2": F.floor("u"), "v2": F.floor("v")})
    first = F.pow(F.col("u") - F.col("u1"), F.lit(2)) + 3 * F.pow(F.col("v") - F.col("v1"), F.lit(2))
    second = F.pow(F.col("u") - F.col("u2") - 0.5, F.lit(2)) + 3 * F.pow(F.col("v") - F.col("v2") - 0.5, F.lit(2))
    near = first < second
    cell = p.select(F.when(near, F.col("u1").cast("double")).otherwise(F.col("u2") + 0.5).alias("cx"), F.when(near, F.col("v1").cast("double")).otherwise(F.col("v2") + 0.5).alias("cy"))
    return cell.groupBy("cx", "cy").agg(F.count("*").alias("n"))
