"""Named sequences: single values for the driver, and gap-free numbers for all rows of a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut_lineage


@dataclass
class Sequence:
    start: int = 1
    step: int = 1
    least: int | None = None
    most: int | None = None
    cycle: bool = False
    value: int | None = None

    def next(self) -> int:
        v = self.start if self.value is None else self.value + self.step
        low = self.least if self.least is not None else (1 if self.step > 0 else -(1 << 63))
        high = self.most if self.most is not None else ((1 << 63) - 1 if self.step > 0 else -1)
        if not low <= v <= high:
            if not self.cycle:
                raise ValueError("the sequence is exhausted")
            v = low if self.step > 0 else high
        self.value = v
        return v


@dataclass
class Registry:
    """The session's sequences by name, in any case."""

    held: dict[str, Sequence] = field(default_factory=dict)
    last: int = 0

    def create(self, name: str, **options) -> Sequence:
        if name.lower() in self.held:
            raise ValueError(f"sequence {name} exists")
        s = self.held[name.lower()] = Sequence(**options)
        return s

    def alter(self, name: str, **options) -> None:
        for k, v in options.items():
            setattr(self.held[name.lower()], {"restart": "value"}.get(k, k), v - self.held[name.lower()].step if k == "restart" else v)

    def drop(self, name: str) -> None:
        del self.held[name.lower()]

    def next(self, name: str) -> int:
        self.last = self.held[name.lower()].next()
        return self.last

    def current(self, name: str) -> int:
        s = self.held[name.lower()]
        return s.value if s.value is not None else s.start - s.step


SEQUENCES = Registry()


def numbered(df: DataFrame, order: list[str], column: str, start: int = 1, step: int = 1) -> DataFrame:
    """Number all rows in an order, without gaps and without one task seeing them all.

    Rows are sorted by range; each partition is numbered by itself and shifted by the rows of the partitions before it,
    of which only the counts meet in one place.  The sorted rows are checkpointed, as ranges are sampled anew each time.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = cut_lineage(df.repartitionByRange(int(n), *order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = placed.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = local.join(F.broadcast(before), "_part")
    return out.withColumn(column, ((F.col("_at") + F.col("_before") - 1) * step + start).cast("long")).drop("_part", "_at", "_before")
