"""Relations without a table: number ranges, literal rows, one empty row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.types import spark_type


def system_range(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    """x from first to last, both included."""
    if not step:
        raise ValueError("the step is zero")
    return spark.range(first, last + (1 if step > 0 else -1), step).select(F.col("id").alias("x"))


def dual(spark: SparkSession) -> DataFrame:
    """One row, x = 1."""
    return spark.range(1).select(F.lit(1).cast("long").alias("x"))


def values(spark: SparkSession, *rows: tuple, names: list[str] | None = None) -> DataFrame:
    """Literal rows; columns c1, c2, ... take the widest type of their values."""
    shown = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"VALUES {shown}").toDF(*(names or [f"c{i + 1}" for i in range(len(rows[0]))]))


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else f"CAST('{v}' AS {'DATE' if type(v).__name__ == 'date' else 'STRING'})"


def table_of(spark: SparkSession, distinct: bool = False, **columns: tuple[str, list]) -> DataFrame:
    """TABLE(name TYPE=(...), ...): lists side by side as rows, short ones padded with nulls; TABLE_DISTINCT if asked."""
    arrays = [F.array(*[F.lit(v) for v in vs]).cast(f"array<{spark_type(t).simpleString()}>").alias(n) for n, (t, vs) in columns.items()]
    rows = spark.range(1).select(F.explode(F.arrays_zip(*arrays)).alias("r")).select(*[F.col("r").getField(n).alias(n) for n in columns])
    return rows.distinct() if distinct else rows
