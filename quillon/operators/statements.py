"""Named prepared statements of a session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Prepared:
    """SQL texts by name, with parameters ? in order, ?1 by place, or :name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def prepare(self, name: str, text: str) -> None:
        """Places become names, as Spark has parameters in order and by name only."""
        self.held[name.lower()] = re.sub(r"\?(\d+)", r":p\1", text)

    def execute(self, name: str, *values, **named) -> DataFrame:
        """The rows of a statement with its parameters' values; an unknown name raises KeyError."""
        text = self.held[name.lower()]
        if named:
            return self.spark.sql(text, args=named)
        if re.search(r":p\d", text):
            return self.spark.sql(text, args={f"p{i + 1}": v for i, v in enumerate(values)})
        return self.spark.sql(text, args=list(values))

    def deallocate(self, name: str) -> None:
        del self.held[name.lower()]
