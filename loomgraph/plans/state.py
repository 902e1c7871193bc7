"""Cutting lineage in driver loops, and sizes that decide between physical forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints"
#: A table is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local default only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL).rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read again: the plan starts afresh and survives lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fits(rows: int, bytes_each: int) -> bool:
    """Whether a table of so many counted rows may be broadcast."""
    return rows * bytes_each <= BROADCAST_BYTES
