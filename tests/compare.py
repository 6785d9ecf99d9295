"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import math

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
        return str(bool(x))
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(x))
    try:
        return f"{float(x):.9g}"
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(value(x) if not isinstance(x, str) else x for x in r) for r in df.itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), oracle(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
