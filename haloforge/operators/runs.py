"""Members that a catalogue lists as runs of a long list: an offset and a length each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a list that are merged with its runs at once.
PER_BUCKET = 4096


def run_members(runs: DataFrame, rows: DataFrame, by: list[str], per_bucket: int | None = None) -> DataFrame:
    """rows (by, position, ...) with the other columns of the run (by, start, length, ...) that holds the position, and member_rank,
    the place in the run; rows in no run go.  Runs of one list don't overlap; runs without members count for nothing.

    Both are cut into buckets of places, each run once for each bucket that it touches, and a bucket's rows are merged with its runs in
    order: no row is made for a place that isn't there, no row meets another run than its own, and a long run is many tasks' work.
    """
    size = F.lit(PER_BUCKET if per_bucket is None else per_bucket)
    others = [c for c in runs.columns if c not in (*by, "start", "length")]
    own = [c for c in rows.columns if c not in by]
    last = F.col("start") + F.col("length") - 1
    touched = runs.where("length > 0").select(*by, F.struct("start", last.alias("last"), *others).alias("__run"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))).alias("__bucket"))
    row_type = rows.select(F.struct(*own).alias("r")).schema["r"].dataType
    heads = touched.select(*by, "__bucket", F.greatest(F.col("__run.start"), F.col("__bucket") * size).cast("long").alias("__at"), F.lit(0).alias("__kind"), "__run", F.lit(None).cast(row_type).alias("__row"))
    body = rows.select(*by, F.floor(F.col("position") / size).alias("__bucket"), F.col("position").cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(heads.schema["__run"].dataType).alias("__run"), F.struct(*own).alias("__row"))
    order = Window.partitionBy(*by, "__bucket").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = heads.union(body).withColumn("__run", F.last("__run", ignorenulls=True).over(order)).where("__kind = 1 and __at <= __run.last")
    return met.select(*by, *[F.col("__row").getField(c).alias(c) for c in own], *[F.col("__run").getField(c).alias(c) for c in others], (F.col("__at") - F.col("__run.start")).alias("member_rank"))


def group_members(groups: DataFrame, particles: DataFrame, halos: DataFrame | None = None, per_bucket: int | None = None) -> DataFrame:
    """groups (row_id, file, length, offset, offset_unbound) and particles (file, position, pid, bound) -> halo_id, member_rank, pid, bound.

    Offsets count from the start of the group's own file, in its list of bound and in its list of unbound particles; a group's length is that of
    both together, and its unbound run ends where that of the next group in the file begins, or the list does.  Bound members come first.
    halo_id is that of the halo (row_id, halo_id) in the same row of the catalogue, or the row_id.
    """
    after = groups.select((F.col("row_id") - 1).alias("row_id"), "file", F.col("offset_unbound").alias("__next"))
    loose = particles.where("not bound").groupBy("file").agg(F.count("*").alias("__loose"))
    known = groups.select("row_id", "file", "length", "offset", "offset_unbound").join(after, ["row_id", "file"], "left").join(loose, "file", "left")
    if halos is None:
        known = known.withColumn("halo_id", F.col("row_id"))
    else:
        known = known.join(halos.select("row_id", "halo_id"), "row_id")
    known = known.withColumn("__n", F.coalesce("__next", "__loose", F.lit(0)) - F.col("offset_unbound"))
    own = known.select("file", F.lit(True).alias("bound"), F.col("offset").alias("start"), (F.col("length") - F.col("__n")).alias("length"), "halo_id", F.lit(0).cast("long").alias("before"))
    other = known.select("file", F.lit(False), "offset_unbound", "__n", "halo_id", F.col("length") - F.col("__n"))
    met = run_members(own.union(other), particles.select("file", "bound", "position", "pid"), ["file", "bound"], per_bucket)
    return met.select("halo_id", (F.col("before") + F.col("member_rank")).alias("member_rank"), "pid", "bound")


def members_by_type(objects: DataFrame, particles: DataFrame, key: str = "sub_id", per_bucket: int | None = None) -> DataFrame:
    """objects (key, offset_type, len_type) and particles (ptype, position, pid) -> key, ptype, member_rank, pid: the arrays have for each
    type where the object's particles begin among all of the type, and how many they are."""
    each = objects.select(key, F.posexplode(F.arrays_zip("offset_type", "len_type")).alias("ptype", "x"))
    runs = each.select("ptype", F.col("x.offset_type").alias("start"), F.col("x.len_type").alias("length"), key)
    met = run_members(runs, particles.select("ptype", "position", "pid"), ["ptype"], per_bucket)
    return met.select(key, "ptype", "member_rank", "pid")
