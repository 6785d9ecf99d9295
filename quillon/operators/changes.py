"""INSERT, UPDATE, DELETE and MERGE as functions from a table's rows to its new rows, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.relational import small


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """table with further rows; columns that they lack take their defaults, else null."""
    given = {c.lower(): c for c in rows.columns}
    if extra := set(given) - {c.lower() for c in table.columns}:
        raise ValueError(f"no such columns: {sorted(extra)}")
    fill = defaults or {}
    new = rows.select(*[(F.col(given[c.lower()]) if c.lower() in given else fill.get(c, F.lit(None))).cast(t).alias(c) for c, t in table.dtypes])
    return table.unionByName(new)


def first_rows(table: DataFrame, where: Column | None, limit: int, keys: list[str]) -> DataFrame:
    """The keys of the first matching rows by their keys, which name each row; the limit bounds what meets in one task."""
    hit = table.where(where) if where is not None else table
    return small(hit.select(*keys).orderBy(*keys).limit(limit))


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None, limit: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """table with columns set where the condition is true; all values are computed from the old row.

    With a limit only so many rows change, the first by their keys.
    """
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    if limit is not None:
        chosen = first_rows(table, where, limit, keys).withColumn("_chosen", F.lit(True))
        table, hit = table.join(chosen, keys, "left").select(*table.columns, "_chosen"), F.coalesce("_chosen", F.lit(False))
    kinds = [(c, t) for c, t in table.dtypes if c != "_chosen"]
    return table.select(*[(F.when(hit, values[c].cast(t)).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c, t in kinds])


def update_from(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], where: Column | None = None) -> DataFrame:
    """SET (columns) = (subquery correlated by keys): the subquery's row for each key, nulls where it has none.

    A subquery with several rows for a key that is asked for raises.
    """
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*columns)).alias("_new"))
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    marked = table.join(one, keys, "left")
    several = F.raise_error(F.lit("the subquery has several rows"))
    new = lambda c, t: F.when(hit & (F.col("_n") > 1), several.cast(t)).when(hit, F.col(f"_new.{c}").cast(t)).otherwise(F.col(c))
    return marked.select(*[(new(c, t) if c in columns else F.col(c)).alias(c) for c, t in table.dtypes])


def delete(table: DataFrame, where: Column | None = None, limit: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """table without the rows for which the condition is true; rows for which it is null stay.

    With a limit only so many rows go, the first by their keys.
    """
    if limit is not None:
        return table.join(first_rows(table, where, limit, keys), keys, "left_anti").select(*table.columns)
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def merge(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows replace those with equal keys and are added otherwise; columns that rows lack keep their old values.

    Of several rows with one key the last counts: that with the greatest order, or without one the last as the rows'
    partitions hold them.  Null keys match nothing.
    """
    if not keys:
        raise ValueError("a key is needed")
    other = [c for c in rows.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    placed = rows.withColumn("_order", F.monotonically_increasing_id() if order is None else order)
    last = placed.where(known).groupBy(*keys).agg(F.max_by(F.struct(*other) if other else F.struct(F.lit(1)), F.col("_order")).alias("_new"))
    joined = table.withColumn("_old", F.lit(True)).join(last, keys, "full")
    kept = [F.col(c) if c in keys else (F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in other else F.col(c)) for c in table.columns]
    merged = joined.select(*[x.cast(t).alias(c) for x, (c, t) in zip(kept, table.dtypes)])
    return merged.unionByName(rows.where(~known).select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in table.dtypes]))


def violations(table: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; null passes."""
    return table.where(~F.coalesce(check, F.lit(True)))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Key values that several rows share; keys with a null are not compared."""
    known = table
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent; a null in the reference passes."""
    known = child
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    names = parent.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)]).distinct()
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]
    return known.join(names, on, "left_anti")


def referential_delete(parent: DataFrame, gone: Column, child: DataFrame, column: str, key: str, action: str = "restrict", default: object = None) -> tuple[DataFrame, DataFrame]:
    """Delete parent rows and act on their children: cascade, set null, set default, or restrict (children then keep their parents)."""
    lost = parent.where(F.coalesce(gone, F.lit(False))).select(F.col(key).alias("_lost")).distinct()
    match = F.col(column) == F.col("_lost")
    if action == "restrict":
        held = child.select(F.col(column).alias("_held")).distinct()
        kept = parent.where(~F.coalesce(gone, F.lit(False))).unionByName(parent.where(gone).join(held, F.col(key) == F.col("_held"), "left_semi"))
        return kept, child
    kept = delete(parent, gone)
    if action == "cascade":
        return kept, child.join(lost, match, "left_anti")
    value = F.lit(None if action == "set null" else default)
    marked = child.join(lost, match, "left")
    return kept, marked.withColumn(column, F.when(F.col("_lost").isNotNull(), value.cast(dict(child.dtypes)[column])).otherwise(F.col(column))).drop("_lost")
