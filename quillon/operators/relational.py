"""Joins, quantified predicates, set operations, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One side of a join is broadcast up to so many rows, by their count.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Equality on all columns of the same name, each shown once; the product if there are none."""
    shared = [c for c in a.columns if c.lower() in {x.lower() for x in b.columns}]
    return a.join(b, shared, how) if shared else a.crossJoin(b)


def right_join(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """A right join; b's columns stand first."""
    return b.join(a, on, "left")


def band_join(a: DataFrame, b: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of a whose point lies in b's closed interval [low, high], as an equi-join on bands of a width.

    Bands double in width from level to level, and an interval is placed at the level where it touches two or three of
    them, so a wide one costs no more rows than a narrow one; a point is looked up once at each level that occurs.
    """
    size = F.col(high) - F.col(low)
    level = F.when(size > width, F.ceil(F.log2(size / width))).otherwise(0).cast("int")
    scale = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    placed = b.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    levels = [r["_level"] for r in placed.select("_level").distinct().collect()]  # at most one for each power of two
    right = placed.withColumn("_band", F.explode(F.sequence(F.floor(F.col(low) / scale), F.floor(F.col(high) / scale))))
    at = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    left = a.withColumn("_level", F.explode(at)).withColumn("_band", F.floor(F.col(point) / scale))
    return left.join(right, ["_level", "_band"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_level", "_band")


def not_in(a: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value is in none of the values, by three-valued logic: a null among the values leaves no row,
    and a null value stays only if there are no values."""
    name = values.columns[0]
    state = values.agg(F.count("*").alias("_n"), F.count(name).alias("_known"))
    kept = a.join(values.where(F.col(name).isNotNull()).select(F.col(name).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_anti")
    ok = (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(column).isNotNull())
    return kept.join(F.broadcast(state)).where(ok).drop("_n", "_known")


_COMPARE = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def quantified(a: DataFrame, left: Column, op: str, quantifier: str, values: DataFrame, name: str = "result") -> DataFrame:
    """a with a column that holds left op ALL | ANY | SOME (values), by three-valued logic.

    The values are reduced to one row (count, nulls, least, greatest, whether all are equal), which joins every row of a;
    = ANY and <> ALL ask for membership, by an equi-join.
    """
    v = values.columns[0]
    if (op, quantifier.upper()) in (("=", "ANY"), ("=", "SOME"), ("<>", "ALL")):
        state = values.agg(F.count("*").alias("_n"), F.count(v).alias("_k"))
        known = values.where(F.col(v).isNotNull()).select(F.col(v).alias("_v")).distinct().withColumn("_hit", F.lit(True))
        met = a.join(known, left == F.col("_v"), "left").join(F.broadcast(state))
        found = F.when(F.col("_hit"), True).when(F.col("_n") == 0, False).when(left.isNull() | (F.col("_n") > F.col("_k")), F.lit(None)).otherwise(False)
        return met.withColumn(name, found if op == "=" else ~found).drop("_v", "_hit", "_n", "_k")
    one = values.agg(F.count("*").alias("_n"), F.count(v).alias("_k"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    # A comparison holds for all (some) values if it holds for the value that it is hardest (easiest) for.
    everything = quantifier.upper() == "ALL"
    lo, hi = F.col("_lo"), F.col("_hi")
    if op in ("=", "<>"):
        met = (left == lo) & (lo == hi) if everything else ~((left == lo) & (lo == hi))
    else:
        up = op in (">", ">=")
        met = _COMPARE[op](left, (hi if up else lo) if everything else (lo if up else hi))
    unknown = F.col("_n") > F.col("_k")
    none = F.col("_n") == 0
    if everything:
        r = F.when(none, True).when(F.col("_k") == 0, F.lit(None)).when(met == F.lit(False), False).when(unknown, F.lit(None)).otherwise(met)
    else:
        r = F.when(none, False).when(F.col("_k") == 0, F.lit(None)).when(met, True).when(unknown, F.lit(None)).otherwise(met)
    return a.join(F.broadcast(one)).withColumn(name, r.cast("boolean")).drop("_n", "_k", "_lo", "_hi")


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows by position, with the first frame's names; frames of other widths raise."""
    if len({len(f.columns) for f in frames}) > 1:
        raise ValueError("column counts differ")
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def order(*keys: str) -> list[Column]:
    """Sort keys from texts such as "a desc nulls last"; nulls are low unless said otherwise."""
    out = []
    for k in keys:
        words = k.split()
        name, rest = words[0], " ".join(words[1:]).lower()
        down = rest.startswith("desc")
        first = rest.endswith("nulls first") or (not rest.endswith("nulls last") and not down)
        c = F.col(name)
        out.append({(False, True): c.asc_nulls_first, (False, False): c.asc_nulls_last, (True, True): c.desc_nulls_first, (True, False): c.desc_nulls_last}[down, first]())
    return out


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """df sorted by keys as order() reads them; a whole number stands for the column of that place, a negative one for its
    descending order."""
    named = []
    for k in keys:
        first, _, rest = k.partition(" ")
        if first.lstrip("-").isdigit():
            if not 1 <= abs(int(first)) <= len(df.columns):
                raise ValueError(f"no column {first}")
            down = first.startswith("-") != rest.lower().startswith("desc")
            nulls = rest.lower()[rest.lower().find("nulls") :] if "nulls" in rest.lower() else ""
            k = f"{df.columns[abs(int(first)) - 1]} {'desc' if down else 'asc'} {nulls}".strip()
        named.append(k)
    return df.orderBy(*order(*named))


def row_numbers(df: DataFrame, column: str = "rownum") -> DataFrame:
    """df with each row's place, from 1, in the order in which its partitions hold the rows; only counts meet in one place.

    df should be stored rows, whose partitions are the same each time they are read.
    """
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = small(counts.select("_part", before.alias("_before")))
    return placed.withColumn("_part", part).join(bases, "_part").withColumn(column, F.col("_before") + within + 1).drop("_at", "_part", "_before")


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Limit and offset of an ordered frame; a null or negative limit is none."""
    out = df.offset(offset) if offset and offset > 0 else df
    return out if limit is None or limit < 0 else out.limit(limit)


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows by the keys: each task keeps k rows at most."""
    return df.orderBy(*order(*keys)).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, *keys: str) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order(*keys)))).where(F.col("_k") <= k).drop("_k")
