"""SQL type names and the Spark types that hold their values; enumerations and domains."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of each type.
NAMES = {
    "BOOLEAN": T.BooleanType(), "BIT": T.BooleanType(), "BOOL": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "YEAR": T.ShortType(), "INT2": T.ShortType(),
    "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "MEDIUMINT": T.IntegerType(), "INT4": T.IntegerType(), "SIGNED": T.IntegerType(), "SERIAL": T.IntegerType(), "BIGINT": T.LongType(),
    "INT8": T.LongType(), "LONG": T.LongType(), "IDENTITY": T.LongType(), "BIGSERIAL": T.LongType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "FLOAT": T.DoubleType(),
    "FLOAT8": T.DoubleType(), "REAL": T.FloatType(), "FLOAT4": T.FloatType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType(),
    "SMALLDATETIME": T.TimestampNTZType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "LONGVARBINARY": T.BinaryType(), "RAW": T.BinaryType(), "BYTEA": T.BinaryType(),
    "BLOB": T.BinaryType(), "TINYBLOB": T.BinaryType(), "MEDIUMBLOB": T.BinaryType(), "LONGBLOB": T.BinaryType(), "IMAGE": T.BinaryType(), "OTHER": T.BinaryType(), "OBJECT": T.BinaryType(),
    "JAVA_OBJECT": T.BinaryType(), "VARCHAR": T.StringType(), "VARCHAR2": T.StringType(), "NVARCHAR": T.StringType(), "NVARCHAR2": T.StringType(), "LONGVARCHAR": T.StringType(),
    "CHAR": T.StringType(), "CHARACTER": T.StringType(), "NCHAR": T.StringType(), "CLOB": T.StringType(), "TEXT": T.StringType(), "NTEXT": T.StringType(), "NCLOB": T.StringType(),
    "TINYTEXT": T.StringType(), "MEDIUMTEXT": T.StringType(), "LONGTEXT": T.StringType(), "VARCHAR_IGNORECASE": T.StringType("UTF8_LCASE"), "UUID": T.StringType(), "ENUM": T.StringType(),
}
DECIMALS = ("DECIMAL", "DEC", "NUMERIC", "NUMBER")
DOMAINS: dict[str, Domain] = {}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name; LIST and SET become arrays, MAP a map, with element types in angle brackets."""
    n = " ".join(name.upper().split())
    if n in DOMAINS:
        return DOMAINS[n].type
    if n == "TIME":
        return T.TimeType()
    if m := re.fullmatch(r"(LIST|SET|ARRAY)\s*<(.+)>", n):
        return T.ArrayType(spark_type(m[2]))
    if m := re.fullmatch(r"MAP\s*<(.+)>", n):
        depth, cut = 0, -1
        for i, c in enumerate(m[1]):
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                cut = i
                break
        return T.MapType(spark_type(m[1][:cut]), spark_type(m[1][cut + 1 :]))
    if n in ("LIST", "SET", "ARRAY"):
        return T.ArrayType(T.StringType())
    m = re.fullmatch(r"([A-Z_0-9 ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", n)
    if m and m[1] in DECIMALS:
        return T.DecimalType(min(38, int(m[2] or 38)), int(m[3] or (0 if m[2] else 18)))
    if n.startswith("ENUM"):
        return T.StringType()
    if m and m[1] in NAMES:
        return NAMES[m[1]]
    raise ValueError(f"no such type: {name}")


@dataclass
class Enum:
    """Labels with ordinals counted from 1; columns hold labels."""

    labels: list[str]

    def ordinal(self, label: Column) -> Column:
        return F.when(label.isNotNull(), F.nullif(F.array_position(F.array(*map(F.lit, self.labels)), label), F.lit(0))).cast("int")

    def label(self, ordinal: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), ordinal - 1)

    def checked(self, label: Column) -> Column:
        """The label; one that is not of the enumeration raises."""
        return F.when(label.isNull() | label.isin(self.labels), label).otherwise(F.raise_error(F.concat(F.lit("no such label: "), label)))


@dataclass
class Domain:
    """A named type with a default and a check."""

    type: T.DataType
    default: object = None
    check: Callable[[Column], Column] | None = field(default=None)

    def apply(self, c: Column) -> Column:
        """Cast, fill in the default, and raise where the check is false."""
        v = c.cast(self.type)
        v = F.coalesce(v, F.lit(self.default)) if self.default is not None else v
        return v if self.check is None else F.when(F.coalesce(self.check(v), F.lit(True)), v).otherwise(F.raise_error(F.lit("check violated")).cast(self.type))


def create_domain(name: str, type_name: str, default: object = None, check: Callable[[Column], Column] | None = None) -> Domain:
    d = DOMAINS[name.upper()] = Domain(spark_type(type_name), default, check)
    return d


def drop_domain(name: str) -> None:
    del DOMAINS[name.upper()]
