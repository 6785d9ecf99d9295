"""User functions, aggregates and table functions: examples of each kind, and their registration for SQL.

Scalar functions are vectorised; aggregates work on a group's values; table functions give rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What create_alias and create_aggregate have made, by name.
ALIASES: dict[str, Callable] = {}


def create_alias(spark: SparkSession, name: str, f: Callable, returns: str, vectorised: bool = True) -> Callable:
    """Register a Python function for SQL and DataFrames; vectorised ones take and give pandas Series."""
    u = F.pandas_udf(f, returns) if vectorised else F.udf(f, returns, useArrow=True)
    ALIASES[name.lower()] = spark.udf.register(name, u)
    return ALIASES[name.lower()]


def create_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str) -> Callable:
    """Register an aggregate that sees all of a group's values at once, so groups must fit in a task; where they may not,
    use aggregate_by_parts."""

    def run(v: pd.Series) -> object:
        return f(v)

    run.__annotations__ = {"v": pd.Series, "return": object}
    ALIASES[name.lower()] = spark.udf.register(name, F.pandas_udf(run, returns))
    return ALIASES[name.lower()]


def aggregate_by_parts(df: DataFrame, group: list[str], value: str, partial: Callable[[pd.Series], dict], merge: dict[str, Callable[[Column], Column]], state: str) -> DataFrame:
    """A user aggregate in two steps: partial gives the state of some of a group's values, merge an aggregate for each of its fields.

    Each Arrow batch is reduced to one row a group before anything is shuffled, so a group of any size meets as few rows
    as there are batches.  state is the SQL schema of the partial rows, in
    the order of merge.
    """
    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(b[g].to_pylist() for g in group))):  # Arrow's values: nulls and large integers stay
                places.setdefault(k, []).append(i)
            values = b[value].to_pandas()
            states = [partial(values.iloc[at]) for at in places.values()]
            columns = {g: pa.array([k[j] for k in places], b[g].type) for j, g in enumerate(group)}
            yield pa.RecordBatch.from_pydict(columns | {c: [x[c] for x in states] for c in merge})

    parts = df.select(*group, value).mapInArrow(run, f"{kinds}, {state}")
    return parts.groupBy(*group).agg(*[m(F.col(c)).alias(c) for c, m in merge.items()])


def drop_alias(spark: SparkSession, name: str) -> None:
    ALIASES.pop(name.lower(), None)
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def initials(v: pd.Series) -> pd.Series:
    """The first letters of a text's words."""
    return v.map(lambda s: None if s is None else "".join(w[0] for w in s.split()))


@F.udtf(returnType="word string, at int")
class SplitWords:
    """A row for each blank-separated word of a text, with its place from 1."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            if w:
                yield w, i + 1
