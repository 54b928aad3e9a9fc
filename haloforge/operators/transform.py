"""Unit conversion, mesh cells, gas particles, galaxy totals, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloforge.cosmology import DM, GAS, RHOCRIT0, SimHeader
from haloforge.functions.columns import trunc0
from haloforge.work import materialize

POSITION = ("x", "y", "z")


def convert_units(particles: DataFrame, header: SimHeader, to_physical: bool = False, to_comoving: bool = False, per_littleh: bool = False, littleh: bool = False) -> DataFrame:
    """Positions (and box_size) times a, then by a; positions and masses times h, then by h, as asked and in that order.
    Velocities stay."""
    a, h = header.scale_factor, header.hubble
    lengths = [c for c in (*POSITION, "box_size") if c in particles.columns]
    masses = [c for c in ("mass",) if c in particles.columns]
    changes: dict[str, Column] = {}

    def apply(names: list[str], f) -> None:
        for n in names:
            changes[n] = f(changes.get(n, F.col(n)))

    if to_physical:
        apply(lengths, lambda c: c * a)
    if to_comoving:
        apply(lengths, lambda c: c / a)
    if per_littleh:
        apply(lengths + masses, lambda c: c * h)
    if littleh:
        apply(lengths + masses, lambda c: c / h)
    return particles.withColumns(changes) if changes else particles


def mesh_cells(particles: DataFrame, offset: tuple[float, float, float], size: float, n: int) -> DataFrame:
    """Columns cx, cy, cz: n (pos - offset) / size, cut towards zero, not held within the mesh."""
    return particles.withColumns({f"c{c}": trunc0(n * (F.col(c) - o) / size) for c, o in zip(POSITION, offset, strict=True)})


def galaxy_totals(galaxies: DataFrame) -> DataFrame:
    return galaxies.withColumns({f"{k}_tot": F.col(f"{k}_disk") + F.col(f"{k}_bulge") for k in ("mstar", "mgas", "matom")})


def add_gas(particles: DataFrame, header: SimHeader, omega_bar: float = 0.0491, offset: float = 0.25, first_mass: float | None = None) -> DataFrame:
    """Split each dark matter particle into gas and dark matter, for initial conditions without gas.

    Gas takes the share fg = omega_bar / omega0 of the mass and moves by -(1 - fg) offset d, dark matter by -offset d,
    with d the mean distance of particles.  Gas ids count from 0 in row order; all older ids are moved up by the number
    of gas particles.  ``first_mass``: a dark matter particle's mass; by default the first row's.
    """
    is_dark = F.col("ptype") == DM
    dark = particles.where(is_dark)
    wanted = [F.count_if(F.col("ptype") == GAS), F.count_if(is_dark)]
    if first_mass is None:
        wanted.append(F.min_by("mass", F.when(is_dark, F.col("row_id"))))
    n_gas, n, *first = particles.agg(*[c.alias(f"v{i}") for i, c in enumerate(wanted)]).first()
    if n_gas:
        raise ValueError("there is gas already")
    if first_mass is None:
        first_mass = first[0]
    fg = omega_bar / header.omega0
    fd = 1.0 - fg
    d = (first_mass / header.omega0 / RHOCRIT0) ** (1.0 / 3.0)
    ranked = rank_from_zero(dark, "row_id", "gas_id")
    gas = ranked.withColumns({c: F.col(c) - fd * offset * d for c in POSITION}).withColumns({"mass": fg * F.col("mass"), "ptype": F.lit(GAS), "pid": F.col("gas_id"), "u": F.lit(100.0), "hsml": F.lit(d)}).drop("gas_id")
    moved = particles.withColumns({c: F.when(F.col("ptype") == DM, F.col(c) - offset * d).otherwise(F.col(c)) for c in POSITION})
    moved = moved.withColumns({"mass": F.when(F.col("ptype") == DM, fd * F.col("mass")).otherwise(F.col("mass")), "pid": F.col("pid") + n})
    return gas.unionByName(moved, allowMissingColumns=True)


def running_sum(rows: DataFrame, key: str, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over all rows of a lesser ``key`` (distinct integers).

    Keys are cut into ranges of about equally many rows, however sparse or crowded they are; a range is summed on its own, and only one row for each
    range meets in one place.  The ranges are written once, as their bounds are drawn from a sample.  ``ranges``: how many; by default
    as many as adaptive execution finds fit the size.
    """
    ranged = materialize(rows.repartitionByRange(*([ranges] if ranges else []), key).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = totals.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(key)) - F.col(value)
    return ranged.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to ranges of about equally many and sorted there, with ``__at``: the range's number, and in the lower 33 bits the place in it."""
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())


def _ranked(ordered: DataFrame, out: str) -> DataFrame:
    """Rows of ``_in_order`` with ``out``, the rank that ``__at`` stands for.  They are written once, and so is the one row for each
    range that meets in one place: whoever uses the result again reads it, and nothing is sorted or counted anew."""
    written = materialize(ordered, "ranges")
    ranged = written.withColumn("__range", F.shiftright("__at", 33))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = materialize(counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before")), "before")
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(before), "__range").withColumn(out, rank).drop("__range", "__at", "__before")


def rank_from_zero(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``out``: the rank of distinct integer keys, from 0 on, without bringing all rows to one task.  Rows of a repeated key, or of none, all have
    the rank of their last; the exchange by ranges of the key serves for that as well."""
    last = F.max("__at").over(Window.partitionBy(key))
    return _ranked(_in_order(rows, key).withColumn("__at", last), out)


def rank_of_rows(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``out``: the rank of every row from 0 on, by an integer key and then by all other columns; repeated keys and rows
    each have a rank of their own.  Rows without a key come first in it, and are left out.

    Rows are exchanged once, by ranges of all columns, so one key's rows may lie in several.
    """
    others = [c for c in rows.columns if c != key]
    return _ranked(_in_order(rows, key, *others), out).where(F.col(key).isNotNull()).select(key, *others, out)


def type_positions(particles: DataFrame) -> DataFrame:
    """With ``position``: the rank of each row among those of its type, by row_id."""
    ranked = rank_from_zero(particles.withColumn("__key", F.shiftleft(F.col("ptype").cast("long"), 56) + F.col("row_id")), "__key", "__rank").drop("__key")
    first = type_offsets(particles).select("ptype", "first")
    return ranked.join(first, "ptype").withColumn("position", F.col("__rank") - F.col("first")).select(*particles.columns, "position")


def type_counts(particles: DataFrame) -> DataFrame:
    return particles.groupBy("ptype").agg(F.count("*").alias("n"))


def type_offsets(particles: DataFrame) -> DataFrame:
    """Where each type's rows begin and end, if rows are sorted by type.  There are a handful of types."""
    upto = F.sum("n").over(Window.orderBy("ptype"))
    return type_counts(particles).select("ptype", (upto - F.col("n")).alias("first"), upto.alias("last"))
