"""Scripts of SQL statements, and export and import of whole databases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def statements(text: str) -> list[str]:
    """The statements of a script, parted by semicolons outside quotes and comments."""
    out, at, i, n = [], [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" and c == "'" else 1
            at.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("--", i):
            i = n if (j := text.find("\n", i)) < 0 else j
        elif text.startswith("/*", i):
            i = n if (j := text.find("*/", i)) < 0 else j + 2
        elif c == ";":
            out.append("".join(at).strip())
            at, i = [], i + 1
        else:
            at.append(c)
            i += 1
    return [s for s in [*out, "".join(at).strip()] if s]


def run_script(spark: SparkSession, text: str) -> DataFrame | None:
    """Run the statements in order; the last one's result."""
    result = None
    for s in statements(text):
        result = spark.sql(s)
    return result


def dump(spark: SparkSession, folder: str, *tables: str) -> None:
    """Export tables as Parquet with a file of their schemas."""
    schemas = []
    for t in tables:
        df = spark.table(t)
        df.write.mode("overwrite").parquet(f"{folder}/{t}")
        schemas.append((t, df.schema.json()))
    spark.createDataFrame(schemas, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/_schemas")


def create_statement(df: DataFrame, table: str) -> str:
    """CREATE TABLE with the columns of a frame."""
    columns = [f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in df.schema]
    return f"CREATE TABLE {table} ({', '.join(columns)});"


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement a row, in a column named statement; made where the rows are."""
    texts = []
    for f in df.schema:
        c = F.col(f.name)
        quoted = F.concat(F.lit("'"), F.regexp_replace(c.cast("string"), r"(['\\])", r"\\$1"), F.lit("'"))
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            text = c.cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
        elif isinstance(f.dataType, T.StringType):
            text = quoted
        else:
            text = F.concat(F.lit("CAST("), quoted, F.lit(f" AS {f.dataType.simpleString()})"))
        texts.append(F.coalesce(text, F.lit("NULL")))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} VALUES ("), F.array_join(F.array(*texts), ", "), F.lit(");")).alias("statement"))


def restore(spark: SparkSession, folder: str) -> list[str]:
    """Make the tables of an export known as temporary views."""
    names = []
    for r in spark.read.schema("name string, schema string").json(f"{folder}/_schemas").collect():
        schema = T.StructType.fromJson(json.loads(r["schema"]))
        spark.read.schema(schema).parquet(f"{folder}/{r['name']}").createOrReplaceTempView(r["name"])
        names.append(r["name"])
    return sorted(names)
