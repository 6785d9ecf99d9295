"""Session settings, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no spark.checkpoint.dir.
DEFAULT_CHECKPOINTS = "file:///tmp/checkpoints"

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; further settings are given with underscores for dots."""
    b = SparkSession.builder.appName("quillon").config(map=SETTINGS)
    if master:
        b = b.master(master)
    return b.config(map={k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or DEFAULT_CHECKPOINTS


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that all executors share."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
