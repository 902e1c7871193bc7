"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the ASCII white space below.  ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where no cluster folder is configured (tests, one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
NO_ID = -(2**63)


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound what one Arrow batch holds, so that a Python worker's memory doesn't depend on document length, and let
    Spark delete each job's shuffle files when the job ends: the operators write what they read again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    for name, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")):
        with contextlib.suppress(Exception):  # a cluster may fix these settings
            spark.conf.set(name, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local default only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = LOCAL_CHECKPOINTS
    return named.rstrip("/")


#: What this driver has written and not deleted yet.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives the loss of executors."""
    spark = session_of(df)
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        for path in [p for f in df.inputFiles()[:1] for p in list(_written) if p.rsplit("/", 1)[1] in f]:
            _delete(_written.pop(path), path)


@atexit.register
def sweep() -> None:
    """Delete all that this driver has materialized: results that aren't saved elsewhere end with it."""
    for path, spark in list(_written.items()):
        del _written[path]
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(spark, path)


def release() -> None:
    """Give freed memory back to the system, so that idle Python workers hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shards_for(size: int | None, each: int, least: int = 1) -> int:
    """A shard count that grows with a measured size, so that what one task holds doesn't."""
    return max(least, -(-int(size or 0) // each))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and the text as UTF-8 bytes; all other columns, whatever their names, are left out here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def bounded(texts: DataFrame, chosen: DataFrame, most: int, *by: str) -> DataFrame:
    """The texts (doc_id, text) of the chosen ids with the columns ``by``: at most ``most`` different rows, however often
    an id or a row repeats, taken by hash."""
    hashed = texts.withColumn("h", F.xxhash64("text"))
    keys = hashed.join(F.broadcast(chosen), "doc_id").select("doc_id", *by, "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h", *by).limit(most)
    return hashed.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", *by]).drop("h")


def row_keys() -> list[Column]:
    """k1, k2 name a row by its id and its text: rows that repeat an id with another text stay apart."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k1"), F.hash("text").alias("k2")]


def crc_fold(mod: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def u64(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of each number (in place where it can)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words_of(text: str | None) -> list[str]:
    """The same words in plain Python, for tests."""
    return re.findall(WORD, text or "")
