"""Whole files as values, and tables written for fast lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of each file; content is read only if asked for."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file's text as one row."""
    return spark.read.text(path, wholetext=True)


def write_clustered(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Parquet sorted by key ranges, so that row-group statistics skip most of it for range and equality conditions.

    This takes the place of a clustered or secondary index.
    """
    placed = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, path: str | None = None) -> None:
    """A table in hash buckets of its keys, in a folder of its own if given: joins and groupings on them need no shuffle.
    This takes the place of a hash index."""
    w = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(table)
