"""Results page by page, and a growing table's new files as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession


def pages(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """Rows in pages; one partition at a time reaches the driver, the next one being fetched meanwhile."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while page := list(islice(rows, size)):
        yield page


def follow(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the rows of new Parquet files in a folder."""
    return spark.readStream.schema(like.schema).parquet(path)


def append_new(spark: SparkSession, path: str, like: DataFrame, target: str, checkpoint: str) -> None:
    """Copy the rows of files not yet seen to another folder, each exactly once, and stop."""
    q = follow(spark, path, like).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
    q.awaitTermination()
