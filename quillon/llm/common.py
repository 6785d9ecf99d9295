"""Helpers that the training-data operators share: tables, scratch folder, lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no spark.checkpoint.dir, as in tests.
DEFAULT_SCRATCH = "file:///tmp/checkpoints"
#: Tables of at most so many narrow rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more rows than the HOT-th part of all: at most HOT keys are, whatever the input.
HOT, HOT_LEAST = 200, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder name in the shared checkpoint folder; nothing is created yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = DEFAULT_SCRATCH
    return f"{base.rstrip('/')}/quillon/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, and lost executors cost nothing."""
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def join_spread(rows: DataFrame, keyed: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows joined with keyed, which has one row a key and in n how many of all total rows have that key.

    The few hot keys (at most HOT) are broadcast and their rows stay where they are, so no key's rows meet in one task.
    """
    limit = max(HOT_LEAST, total // HOT)
    found = keyed.where(F.col("n") > limit).collect()
    plain = keyed.where(F.col("n") <= limit).drop("n")
    if not found:
        return rows.join(plain, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, keyed.schema).drop("n"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(plain, key))


def ascii_lower(col):
    """Lower-case A to Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(col, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % n


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
