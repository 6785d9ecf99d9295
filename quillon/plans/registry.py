"""The registered queries: a name, a function of (spark, sf_dir), and DuckDB SQL for the same rows where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader, under its own name."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: load(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def sql_query(name: str, spark_sql: str, oracle: str | None = None, *tables: str) -> None:
    """Register Spark SQL over named tables; the oracle is the same text unless another is given."""
    from quillon.tables import register

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables)
        return spark.sql(spark_sql)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or spark_sql
