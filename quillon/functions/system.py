"""Conditional, conversion, collection and session functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillon.functions.strings import col
from quillon.operators.sequences import SEQUENCES
from quillon.types import spark_type


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def casewhen(condition, a, b) -> Column:
    """a where the condition is true, b where it is false or null."""
    return F.when(col(condition), col(a)).otherwise(col(b))


def case(operand, *pairs) -> Column:
    """Simple CASE: value, result, ..., and perhaps a last default; a null operand takes the default."""
    tests, default = pairs[: len(pairs) // 2 * 2], pairs[-1] if len(pairs) % 2 else None
    out = F
    for v, r in zip(tests[::2], tests[1::2]):
        out = out.when(col(operand) == col(v), col(r))
    return out.otherwise(col(default)) if out is not F else col(default)


def decode(operand, *pairs) -> Column:
    """The result of the first equal value, null equal to null, else the last argument if it has no partner."""
    tests, default = pairs[: len(pairs) // 2 * 2], pairs[-1] if len(pairs) % 2 else None
    return reduce(lambda rest, vr: F.when(col(operand).eqNullSafe(col(vr[0])), col(vr[1])).otherwise(rest), list(zip(tests[::2], tests[1::2]))[::-1], col(default))


def cast(x, type_name: str) -> Column:
    """Conversion to a SQL type by any of its names; bad input raises."""
    return col(x).cast(spark_type(type_name))


def truncate_value(x, precision: int, force: bool = False) -> Column:
    """Text and bytes cut to a length; numbers of more digits lose their last ones if forced, and raise otherwise."""
    c = col(x)
    kind = F.typeof(c)
    digits = F.length(F.regexp_replace(c.cast("string"), "[^0-9]", ""))
    number = F.when(digits <= precision, c.cast("string")).when(F.lit(force), F.round(c.cast("double"), 0).cast("string")).otherwise(F.raise_error(F.lit("Numeric value out of range")).cast("string"))
    return F.when(kind.isin("string", "binary"), F.substring(c.cast("string"), 1, precision)).otherwise(number)


def array_get(a, k) -> Column:
    """An array's element, counted from 1, or a map's value; null if there is none, as for places below 1."""
    a, k = col(a), col(k)
    return F.when(F.typeof(a).startswith("array") & (k.try_cast("bigint") < 1), F.lit(None)).otherwise(F.try_element_at(a, k))


def array_contains(a, v) -> Column:
    """Whether an array has a value, or with a list of values all of them."""
    if isinstance(v, (list, tuple)):
        return F.size(F.array_except(F.array(*map(F.lit, v)), col(a))) == 0
    return F.array_contains(col(a), col(v))


def array_length(a) -> Column:
    """An array's number of elements; null for null and for values of other types."""
    whole = F.to_variant_object(F.struct(col(a).alias("a")))
    return F.size(F.try_variant_get(whole, "$.a", "array<variant>"))


def _conf(name: str):
    return lambda: F.lit(session().conf.get(name, None))


def memory(kind: str) -> Column:
    """Free or used kilobytes of the driver's virtual machine."""
    r = session()._jvm.java.lang.Runtime.getRuntime()
    return F.lit(int((r.freeMemory() if kind == "free" else r.totalMemory() - r.freeMemory()) // 1024))


def cancel_session(group: str) -> Column:
    """Cancel the jobs of a job group."""
    session().sparkContext.cancelJobGroup(group)
    return F.lit(True)


def disk_space_used(table: str) -> Column:
    """Bytes of a stored table's files."""
    spark = session()
    total = 0
    for f in spark.table(table).inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return F.lit(total)


def set_variable(name: str, value) -> Column:
    """Set a session variable, making it if needed, and return its value."""
    spark, name = session(), name.lstrip("@")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} = {value!r}")
    return F.expr(f"session.{name}")


def file_read(path: str, charset: str | None = None):
    """A file's content as one row: text if a character set is given, else bytes."""
    df = session().read.format("binaryFile").load(path)
    return df.select(F.decode("content", charset).alias("content") if charset else F.col("content"))


def csvread(path: str, columns=None, options: str = ""):
    from quillon.sources.csv import csv_read

    return csv_read(session(), path, columns, options)


def csvwrite(path: str, query: str, options: str = "") -> int:
    from quillon.sources.csv import csv_write

    return csv_write(session().sql(query), path, options)


def _coalesce(*xs) -> Column:
    return F.coalesce(*[col(x) for x in xs])


def _last_value() -> Column:
    return F.lit(SEQUENCES.last)


FUNCTIONS = {
    "DATABASE": F.current_database, "USER": F.current_user, "CURRENT_USER": F.current_user, "SESSION_USER": F.current_user, "IDENTITY": _last_value, "SCOPE_IDENTITY": _last_value,
    "IDENTITY_VAL_LOCAL": _last_value, "LAST_INSERT_ID": _last_value, "LASTVAL": _last_value, "AUTOCOMMIT": lambda: F.lit(True), "READONLY": lambda: F.lit(False),
    "DATABASE_PATH": _conf("spark.sql.warehouse.dir"), "LOCK_TIMEOUT": lambda: F.lit(0), "IFNULL": _coalesce, "ISNULL": _coalesce, "CASEWHEN": casewhen, "CONVERT": cast, "CAST": cast,
    "TRUNCATE_VALUE": truncate_value, "COALESCE": _coalesce, "NVL": _coalesce, "NVL2": lambda a, b, c: F.when(col(a).isNotNull(), col(b)).otherwise(col(c)),
    "NULLIF": lambda a, b: F.nullif(col(a), col(b)), "CASE": case, "NEXTVAL": lambda name: F.lit(SEQUENCES.next(name)), "CURRVAL": lambda name: F.lit(SEQUENCES.current(name)),
    "ARRAY_GET": array_get, "ARRAY_CONTAINS": array_contains, "CSVREAD": csvread, "CSVWRITE": csvwrite, "MEMORY_FREE": lambda: memory("free"), "MEMORY_USED": lambda: memory("used"),
    "TRANSACTION_ISOLATION_LEVEL": lambda: F.lit(8), "SCHEMA": F.current_schema, "SESSION_ID": lambda: F.lit(session().sparkContext.applicationId), "ARRAY_LENGTH": array_length,
    "LEAST": lambda *xs: F.least(*[col(x) for x in xs]), "GREATEST": lambda *xs: F.greatest(*[col(x) for x in xs]), "CANCEL_SESSION": cancel_session, "SET": set_variable,
    "FILE_READ": file_read, "TRANSACTION_ID": lambda: F.lit(None), "DECODE": decode, "DISK_SPACE_USED": disk_space_used, "VERSION": F.version,
}
