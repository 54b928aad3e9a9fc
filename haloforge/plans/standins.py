"""Simulation entities made from the relational test tables, by expressions that any SQL engine evaluates alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haloforge.operators.transform import rank_from_zero, running_sum
from haloforge.work import materialize

BOX = 100.0
#: Snapshots end here; an order's snapshot counts back from its customer's last order.
LAST_SNAP = 60
OMEGA0, OMEGA_LAMBDA = 0.276, 0.724


def hashed(k: str, n: int) -> str:
    return f"(cast(({k}) % {n} as double) / cast({n} as double))"


_LINE = "l_orderkey * {} + l_partkey * {} + l_suppkey * {} + l_linenumber * {}"
PARTICLES = {
    "pid": "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber",
    "ptype": "cast((l_linenumber - 1) % 6 as int)",
    "x": f"100 * {hashed(_LINE.format(104729, 7919, 31, 611953), 100003)}",
    "y": f"100 * {hashed(_LINE.format(15485863, 32452843, 37, 7907), 100019)}",
    "z": f"100 * {hashed(_LINE.format(49979687, 67867967, 41, 104651), 100043)}",
    "vx": f"400 * ({hashed(_LINE.format(86028121, 1299709, 53, 15487), 100049)} - cast(0.5 as double))",
    "vy": f"400 * ({hashed(_LINE.format(32452867, 2750159, 59, 22307), 100057)} - cast(0.5 as double))",
    "vz": f"400 * ({hashed(_LINE.format(67867979, 4256233, 61, 31337), 100069)} - cast(0.5 as double))",
    "mass": "l_extendedprice / cast(1000 as double)",
    "u": "l_quantity",
    "rho": "l_quantity * (cast(1 as double) + l_tax)",
}
HALOS = {
    "row_id": "c_custkey",
    "halo_id": "c_custkey",
    "host_id": "case when c_custkey % 4 = 0 then -1 else c_custkey - c_custkey % 4 end",
    "structuretype": "case when c_custkey % 4 = 0 then 10 else 20 end",
    "first_in_fof": "c_custkey - c_custkey % 4",
    "x": f"100 * {hashed('c_custkey * 104729', 100003)}",
    "y": f"100 * {hashed('c_custkey * 15485863', 100019)}",
    "z": f"100 * {hashed('c_custkey * 49979687', 100043)}",
    "r200": "cast(2 + c_custkey % 5 as double)",
    "m200": "abs(c_acctbal) + cast(1 as double)",
}
SUBHALOS = {
    "sub_id": "s_suppkey",
    "group_id": "s_suppkey % 50",
    "sub_rank": "cast(s_suppkey % 3 as int)",
    "x": f"100 * {hashed('s_suppkey * 2750159', 100003)}",
    "y": f"100 * {hashed('s_suppkey * 4256233', 100019)}",
    "z": f"100 * {hashed('s_suppkey * 1299709', 100043)}",
    "mass": "abs(s_acctbal) + cast(1 as double)",
}
GALAXIES = {
    "row_id": "p_partkey",
    "mstar_disk": "p_retailprice",
    "mstar_bulge": "cast(p_size as double)",
    "mgas_disk": "p_retailprice / cast(2 as double)",
    "mgas_bulge": "cast(p_size as double) / cast(4 as double)",
    "matom_disk": "p_retailprice / cast(8 as double)",
    "matom_bulge": "cast(p_size as double) / cast(16 as double)",
}
_BACK = "row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)"
NODES = {
    "tree_id": "o_custkey",
    "fof_id": "o_custkey - o_custkey % 4",
    "node_id": "o_orderkey",
    "snapnum": f"cast({LAST_SNAP} + 1 - {_BACK} as int)",
    "redshift": f"cast({_BACK} - 1 as double) / cast(4 as double)",
    "scale_factor": f"cast(1 as double) / (cast(1 as double) + cast({_BACK} - 1 as double) / cast(4 as double))",
    "main_prog": "coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey), -1)",
    "mass": "o_totalprice / cast(1000 as double)",
    "m200": "sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row)",
    "x": f"100 * {hashed('o_orderkey * 104729 + o_custkey * 31', 100003)}",
    "y": f"100 * {hashed('o_orderkey * 15485863 + o_custkey * 37', 100019)}",
    "z": f"100 * {hashed('o_orderkey * 49979687 + o_custkey * 41', 100043)}",
    "vx": f"400 * ({hashed('o_orderkey * 86028121', 100049)} - cast(0.5 as double))",
    "vy": f"400 * ({hashed('o_orderkey * 32452867', 100057)} - cast(0.5 as double))",
    "vz": f"400 * ({hashed('o_orderkey * 67867979', 100069)} - cast(0.5 as double))",
}
#: Lists of a FOF group's nodes at a snapshot, over nodes; the order isn't that of ids.
_LIST = "over (partition by fof_id, snapnum order by tree_id * 7 % 5, tree_id desc)"
FIRST_IN_FOF = f"first_value(node_id) {_LIST} as first_in_fof"
NEXT_IN_FOF = f"coalesce(lead(node_id) {_LIST}, -1) as next_in_fof"
_TABLES = {"particles": ("lineitem", PARTICLES), "halos": ("customer", HALOS), "subhalos": ("supplier", SUBHALOS), "galaxies": ("part", GALAXIES), "nodes": ("orders", NODES)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _TABLES[name]
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return table.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def cte(*names: str) -> str:
    """The same entities as the head of a WITH clause."""
    parts = []
    for name in names:
        source, columns = _TABLES[name]
        parts.append(f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source})")
    return ",\n".join(parts)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """halo_id, pid: each customer's orders' lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr("o_custkey as halo_id", f"{PARTICLES['pid']} as pid")


#: Files that a group catalogue is in, and which lines are bound.
FILES, IS_BOUND = 3, "l_linenumber % 4 <> 0"


def group_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """groups (row_id, file, halo_id, length, offset, offset_unbound) and particles (file, position, pid, bound), as files list them: a group is
    a customer, its members are the orders' lines, by order and line; a file has its groups by halo_id."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    own = lines.join(orders.select("o_orderkey", "o_custkey"), lines["l_orderkey"] == orders["o_orderkey"])
    own = own.selectExpr("o_custkey as halo_id", f"o_custkey % {FILES} as file", f"{PARTICLES['pid']} as pid", f"{IS_BOUND} as bound", "l_orderkey", "l_linenumber")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("halo_id", "bound").orderBy("l_orderkey", "l_linenumber", "pid")) - 1)
    key = F.shiftleft("file", 48) + F.col("halo_id")
    sizes = own.groupBy("file", "halo_id").agg(F.count_if("bound").alias("held"), F.count_if(~F.col("bound")).alias("loose")).withColumn("key", key)
    for count, out in (("held", "offset"), ("loose", "offset_unbound")):
        sizes = running_sum(sizes, "key", count, out)
    starts = sizes.groupBy("file").agg(F.min("offset").alias("a"), F.min("offset_unbound").alias("b"))
    sizes = rank_from_zero(sizes.join(starts, "file").withColumns({"offset": F.col("offset") - F.col("a"), "offset_unbound": F.col("offset_unbound") - F.col("b")}), "key", "row_id")
    sizes = materialize(sizes.select("row_id", "file", "halo_id", (F.col("held") + F.col("loose")).alias("length"), "offset", "offset_unbound"), "groups")
    placed = own.join(sizes.drop("row_id", "length"), ["file", "halo_id"])
    return sizes, placed.select("file", (F.col("rank") + F.when(F.col("bound"), F.col("offset")).otherwise(F.col("offset_unbound"))).alias("position"), "pid", "bound")


def typed_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """subhalos (sub_id, offset_type, len_type) and particles (ptype, position, pid): a subhalo is a supplier, and has its lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey as sub_id", *[f"{PARTICLES[c]} as {c}" for c in ("ptype", "pid")], "l_orderkey", "l_linenumber")
    own = lines.withColumn("rank", F.row_number().over(Window.partitionBy("ptype", "sub_id").orderBy("l_orderkey", "l_linenumber", "pid")) - 1)
    sizes = own.groupBy("ptype", "sub_id").agg(F.count("*").alias("n")).withColumn("key", F.shiftleft(F.col("ptype").cast("long"), 48) + F.col("sub_id"))
    sizes = running_sum(sizes, "key", "n", "start")
    sizes = sizes.join(sizes.groupBy("ptype").agg(F.min("start").alias("a")), "ptype").withColumn("start", F.col("start") - F.col("a"))
    sizes = materialize(sizes.select("ptype", "sub_id", "n", "start"), "sizes")
    arrays = [F.array(*[F.coalesce(F.max(F.when(F.col("ptype") == t, F.col(c))), F.lit(0)) for t in range(6)]).alias(out) for c, out in (("start", "offset_type"), ("n", "len_type"))]
    return sizes.groupBy("sub_id").agg(*arrays), own.join(sizes, ["ptype", "sub_id"]).select("ptype", (F.col("start") + F.col("rank")).alias("position"), "pid")


MEMBERS = f"members as (select o_custkey as halo_id, {PARTICLES['pid']} as pid from lineitem join orders on l_orderkey = o_orderkey)"
