"""Selecting particles and halos: regions, types, members, field halos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloforge.cosmology import BH, DM, GAS, LOW_RES_TYPES, STAR
from haloforge.functions.columns import apart, norm2, offsets


def _near(d: list[Column], size: float, geometry: str) -> Column:
    """d: the sizes of the offsets."""
    if geometry == "cubic":
        return (d[0] < size / 2) & (d[1] < size / 2) & (d[2] < size / 2)
    if geometry == "spherical":
        return norm2(d) < size * size
    raise ValueError(f"geometry is 'cubic' or 'spherical', not {geometry!r}")


def select_particles(particles: DataFrame, centre: Sequence[float], size: float, geometry: str = "cubic", periodic: bool = False, box: float | None = None) -> DataFrame:
    """Rows within a cube of full width ``size`` or a sphere of radius ``size``, borders left out.

    Where the region doesn't reach over the box's border, plain bounds on x, y and z go ahead of the exact test: they
    reach the Parquet reader.
    """
    if periodic and box is None:
        raise ValueError("a periodic selection needs the box")
    reach = size / 2 if geometry == "cubic" else size
    if not periodic or all(reach <= c <= box - reach for c in centre):
        for name, c in zip(("x", "y", "z"), centre, strict=True):
            particles = particles.where((F.col(name) >= c - reach) & (F.col(name) <= c + reach))
    return particles.where(_near([apart(F.col(c) - v, box if periodic else None) for c, v in zip(("x", "y", "z"), centre, strict=True)], size, geometry))


def particles_in_region(particles: DataFrame, centre: Sequence[float] | None = None, size: float | Sequence[float] = 1.0, region: str = "sphere", cut: float = 5.0, members: DataFrame | None = None) -> DataFrame:
    """A region about an object, not periodic, borders included: a sphere of radius ``cut`` times the (first) size, a
    cuboid of half widths ``cut`` times the sizes, or the members (pid) of a halo."""
    if region.lower() == "fof":
        if members is None:
            raise ValueError("a FOF region needs the members")
        return particles.join(members.select("pid"), "pid", "left_semi")
    sizes = [float(s) for s in (size if isinstance(size, Sequence) else [size] * 3)]
    reach = [cut * s for s in (sizes if region in ("cuboid", "cube") else [sizes[0]] * 3)]
    for name, c, h in zip(("x", "y", "z"), centre, reach, strict=True):
        particles = particles.where((F.col(name) >= c - h - 1e-9) & (F.col(name) <= c + h + 1e-9))
    d = offsets(centre)
    if region in ("cuboid", "cube"):
        return particles.where((F.abs(d[0]) <= reach[0]) & (F.abs(d[1]) <= reach[1]) & (F.abs(d[2]) <= reach[2]))
    if region == "sphere":
        return particles.where(norm2(d) <= reach[0] * reach[0])
    raise ValueError(f"region is 'sphere', 'cuboid' or 'FOF', not {region!r}")


def by_type(particles: DataFrame, kind: str = "all") -> DataFrame:
    """One type of particles, or all four; a missing potential is 0."""
    types = {"gas": [GAS], "dm": [DM], "star": [STAR], "bh": [BH], "all": [GAS, DM, STAR, BH]}.get(kind, [DM])
    found = particles.where(F.col("ptype").isin(types))
    potential = F.coalesce(F.col("potential"), F.lit(0.0)) if "potential" in particles.columns else F.lit(0.0)
    return found.withColumn("potential", potential)


def hires_only(particles: DataFrame) -> DataFrame:
    return particles.where(~F.col("ptype").isin(*LOW_RES_TYPES))


def resolve_mass(particles: DataFrame, mass_table: Sequence[float]) -> DataFrame:
    """A type's mass from the header's table, or where that is 0 each particle's own."""
    table = F.array(*[F.lit(float(m)) for m in mass_table])
    constant = F.get(table, F.col("ptype"))
    return particles.withColumn("mass", F.when(F.coalesce(constant, F.lit(0.0)) == 0, F.col("mass")).otherwise(constant))


def field_halos(halos: DataFrame) -> DataFrame:
    """Halos that lie in no other and have a mass within R200."""
    return halos.where((F.col("structuretype") == 10) & (F.col("m200") > 0))


def parent_halos(halos: DataFrame, none: int = 0) -> DataFrame:
    """Halos without a host; ``none`` is how the catalogue writes that: 0 or -1."""
    return halos.where(F.col("host_id") == none)


def nth_parent_halo(halos: DataFrame, rank: int, none: int = 0) -> DataFrame:
    """The parent halo of a rank from 0 on in catalogue order: a distributed top-k, then its last row."""
    first = parent_halos(halos, none).orderBy("row_id").limit(rank + 1)
    counted = first.agg(F.count("*").alias("n"), F.max_by(F.struct(*halos.columns), "row_id").alias("h"))
    return counted.where(F.col("n") == rank + 1).select("h.*")


def satellites(subhalos: DataFrame) -> DataFrame:
    """Subhalos but the central one of each group."""
    return subhalos.where("sub_rank <> 0")


def members_of(halos: DataFrame, pool: DataFrame) -> DataFrame:
    """halos (halo_id, offset, length) and pool (position, pid) -> (halo_id, member_rank, pid); positions from 0 on."""
    where = halos.where("length > 0").select("halo_id", F.posexplode(F.sequence(F.col("offset"), F.col("offset") + F.col("length") - 1)).alias("member_rank", "position"))
    return where.join(pool, "position").select("halo_id", F.col("member_rank").cast("long").alias("member_rank"), "pid")


def substructure_of(substructure: DataFrame, host: int) -> DataFrame:
    """The substructures a file lists for a host, ascending."""
    return substructure.where(F.col("host_id") == host).orderBy("sub_id")
