"""Table definitions: columns changed in place, constants, comments and column statistics.

As elsewhere in this library a statement is a function from a table's rows to its new rows; the caller writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.changes import duplicates, orphans, violations
from quillon.types import spark_type


def _same(a: str, b: str) -> bool:
    return a.lower() == b.lower()


def _known(table: DataFrame, name: str) -> str:
    """The column's name as the table spells it."""
    found = [c for c in table.columns if _same(c, name)]
    if not found:
        raise ValueError(f"no such column: {name}")
    return found[0]


def add_column(table: DataFrame, name: str, type_name: str, default: object = None, before: str | None = None, not_null: bool = False) -> DataFrame:
    """table with a further column, last or before another one, that holds its default (null without one) in all rows."""
    if any(_same(c, name) for c in table.columns):
        raise ValueError(f"column {name} exists")
    if not_null and default is None:
        raise ValueError(f"column {name} needs a default, as old rows would hold null")
    value = (default if isinstance(default, Column) else F.lit(default)).cast(spark_type(type_name)).alias(name)
    at = table.columns.index(_known(table, before)) if before else len(table.columns)
    old = [F.col(c) for c in table.columns]
    return table.select(*old[:at], value, *old[at:])


def drop_column(table: DataFrame, name: str) -> DataFrame:
    """table without a column; its last one can't go."""
    gone = _known(table, name)
    if len(table.columns) == 1:
        raise ValueError("a table keeps its last column")
    return table.drop(gone)


def rename_column(table: DataFrame, name: str, new: str) -> DataFrame:
    """table with a column's name changed; a name that another column has raises."""
    old = _known(table, name)
    if any(_same(c, new) for c in table.columns if c != old):
        raise ValueError(f"column {new} exists")
    return table.withColumnRenamed(old, new)


def change_type(table: DataFrame, name: str, type_name: str) -> DataFrame:
    """table with a column converted; a value that the new type can't hold raises when the rows are read."""
    old = _known(table, name)
    return table.withColumn(old, F.col(old).cast(spark_type(type_name)))


def set_not_null(table: DataFrame, name: str) -> DataFrame:
    """table, of which reading a row with null in the column raises."""
    c = F.col(_known(table, name))
    return table.withColumn(name, F.coalesce(c, F.raise_error(F.lit(f"NULL not allowed for column {name}")).cast(table.schema[_known(table, name)].dataType)))


def add_constraint(table: DataFrame, check: Column | None = None, unique: list[str] | None = None, references: tuple[list[str], DataFrame, list[str]] | None = None) -> DataFrame:
    """table, after its rows were checked; a constraint that they break raises.

    A check passes null, unique keys with a null are all different, and a reference with a null needs no parent.
    """
    broken = []
    if check is not None and not violations(table, check).isEmpty():
        broken.append("check")
    if unique and not duplicates(table, *unique).isEmpty():
        broken.append("unique")
    if references and not orphans(table, *references).isEmpty():
        broken.append("foreign key")
    if broken:
        raise ValueError(f"rows break the constraint: {', '.join(broken)}")
    return table


def truncate(table: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return table.limit(0)


class Constants:
    """Named constants of a session, kept as session variables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def create(self, name: str, value: str) -> None:
        """value is a constant SQL expression."""
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} = {value}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY VARIABLE {name}")

    def __getitem__(self, name: str) -> Column:
        return F.expr(f"session.{name}")


def comment_on_table(spark: SparkSession, table: str, text: str | None) -> None:
    """Set or (with null) remove a catalog table's comment."""
    spark.sql(f"COMMENT ON TABLE {table} IS {'NULL' if text is None else repr(text)}")


def analyze(table: DataFrame, sample: int = 10_000) -> DataFrame:
    """(column_name, n_rows, n_nulls, selectivity): each column's share of different values in percent, 1 to 100.

    Rows are sampled as a share of the table if there are more than sample; 0 reads all.  No rows: selectivity 50.
    """
    if sample and (n := table.count()) > sample:
        table = table.sample(sample / n, seed=42)
    counts = [F.struct(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias("d"), (F.count("*") - F.count(c)).alias("nulls")).alias(f"c{i}") for i, c in enumerate(table.columns)]
    one = table.agg(F.count("*").alias("n"), *counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}.d").alias("d"), F.col(f"c{i}.nulls").alias("n_nulls")) for i, c in enumerate(table.columns)])
    share = F.when(F.col("n") == 0, 50).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), F.floor(100 * F.col("r.d") / F.col("n")))))
    return one.select("n", F.explode(rows).alias("r")).select("r.column_name", F.col("n").alias("n_rows"), "r.n_nulls", share.cast("int").alias("selectivity"))
