"""Aggregates beyond Spark's own, as Columns where one pass does and as functions of DataFrames where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_exact(c: Column) -> Column:
    """Sums of big integers as decimals, which cannot overflow."""
    return F.sum(c.cast("decimal(38,0)"))


def avg_int(c: Column) -> Column:
    """The average of integers, cut to an integer."""
    return F.expr("cast(null as bigint)") if c is None else F.try_divide(F.sum(c), F.count(c)).cast("bigint")


def group_concat(c: Column, separator: str = ",", order_by: Column | None = None, descending: bool = False, distinct: bool = False) -> Column:
    """Joins a group's non-null values; null for none.  With distinct, pairs of value and sort key count once."""
    key = order_by if order_by is not None else F.lit(0)
    pair = F.when(c.isNotNull(), F.struct(key.alias("k"), c.cast("string").alias("x")))
    items = F.collect_set(pair) if distinct else F.collect_list(pair)
    ordered = F.sort_array(items, asc=not descending) if order_by is not None or distinct else items
    return F.when(F.size(items) > 0, F.array_join(F.transform(ordered, lambda e: e["x"]), separator))


def selectivity(c: Column) -> Column:
    """The share of different values in percent, from 1 to 100; 50 for no rows."""
    share = (100 * F.count_distinct(F.coalesce(c.cast("string"), F.lit("\0"))) / F.count("*")).cast("int") if c is not None else F.lit(50)
    return F.when(F.count("*") == 0, 50).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), share)))


def histogram(df: DataFrame, value: str, *group: str) -> DataFrame:
    """For each group an array of (value, n) in the order of values, nulls first.

    Values are counted before they meet, so a group's array is as long as its different values.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("value"), F.col("n")))).alias("histogram"))


def sampled(df: DataFrame, n: int) -> DataFrame:
    """SAMPLE_SIZE: the first n rows that reach the operator above, in no fixed order."""
    return df.limit(n)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()
