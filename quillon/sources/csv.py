"""CSV files with the options of CSVREAD and CSVWRITE."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Option names and those of Spark's reader and writer.
OPTIONS = {
    "escape": "escape", "fielddelimiter": "quote", "fieldseparator": "sep", "linecomment": "comment", "lineseparator": "lineSep", "null": "nullValue", "charset": "encoding",
}


def parse_options(text: str) -> dict[str, str]:
    """Options as "name=value name=value"; a backslash keeps the blank after it."""
    out = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    for m in re.finditer(r"(\w+)=((?:\\.|[^\\ ])*)", text):
        name, value = m[1].lower(), re.sub(r"\\(.)", r"\1", m[2])
        if name in OPTIONS:
            out[OPTIONS[name]] = value
        elif name == "preservewhitespace":
            keep = str(value.lower() != "true").lower()
            out |= {"ignoreLeadingWhiteSpace": keep, "ignoreTrailingWhiteSpace": keep}
        elif name == "writecolumnheader":
            out["header"] = value.lower()
        elif name != "casesensitivecolumnnames":
            raise ValueError(f"no such option: {m[1]}")
    if out.get("encoding", "").lower().startswith(("utf-16", "utf-32")):
        out.setdefault("lineSep", "\n")  # lines are found by the bytes of this mark in the character set
    return out


def csv_read(spark: SparkSession, path: str, columns: list[str] | None = None, options: str = "") -> DataFrame:
    """Rows of text columns, named by the first line unless names are given."""
    o = parse_options(options)
    reader = spark.read.options(**o | ({"header": "false"} if columns else {}))
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def csv_write(df: DataFrame, path: str, options: str = "") -> int:
    """Write rows and return how many there are, counted as they are written."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**parse_options(options)).mode("overwrite").csv(path)
    return seen.get["n"]
