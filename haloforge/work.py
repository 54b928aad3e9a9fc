"""Tables that cut lineage: Parquet in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="haloforge-", dir="/tmp/checkpoints")
    return f"file://{_own[sc.applicationId]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again.  Losing executors afterwards costs a reread, not a recomputation.

    A join of tables read this way has a plain exchange at both sides, which adaptive execution can split where one key has
    very many rows; a join with an aggregate keeps each key in one task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` made and nothing will read again."""
    spark = df.sparkSession
    jvm, home = spark._jvm, work_dir(spark).removeprefix("file://")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        if home in folder:
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
