"""A fluent query builder over DataFrames: conditions on properties, joined by and, or, not and parentheses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillon.operators import changes
from quillon.operators.relational import page


class Property:
    """A column of a query; each method adds a condition and returns the query."""

    def __init__(self, query: Query, name: str):
        self.query, self.name, self.column = query, name, F.col(name)

    def _add(self, c: Column) -> Query:
        return self.query._add(c)

    def eq(self, v): return self._add(self.column == v)  # noqa: E704
    def ne(self, v): return self._add(self.column != v)  # noqa: E704
    def gt(self, v): return self._add(self.column > v)  # noqa: E704
    def ge(self, v): return self._add(self.column >= v)  # noqa: E704
    def lt(self, v): return self._add(self.column < v)  # noqa: E704
    def le(self, v): return self._add(self.column <= v)  # noqa: E704
    def between(self, a, b): return self._add(self.column.between(a, b))  # noqa: E704
    def isin(self, *vs): return self._add(self.column.isin(*vs))  # noqa: E704
    def not_in(self, *vs): return self._add(~self.column.isin(*vs))  # noqa: E704
    def is_null(self): return self._add(self.column.isNull())  # noqa: E704
    def is_not_null(self): return self._add(self.column.isNotNull())  # noqa: E704
    def like(self, p): return self._add(self.column.like(p))  # noqa: E704
    def ilike(self, p): return self._add(self.column.ilike(p))  # noqa: E704
    def ieq(self, v): return self._add(F.lower(self.column) == v.lower())  # noqa: E704
    def starts_with(self, v): return self._add(self.column.startswith(v))  # noqa: E704
    def ends_with(self, v): return self._add(self.column.endswith(v))  # noqa: E704
    def istarts_with(self, v): return self._add(F.lower(self.column).startswith(v.lower()))  # noqa: E704
    def iends_with(self, v): return self._add(F.lower(self.column).endswith(v.lower()))  # noqa: E704
    def icontains(self, v): return self._add(F.lower(self.column).contains(v.lower()))  # noqa: E704
    def match(self, p): return self._add(self.column.rlike(p))  # noqa: E704
    def is_empty(self): return self._add(F.size(self.column) == 0)  # noqa: E704
    def is_not_empty(self): return self._add(F.size(self.column) > 0)  # noqa: E704

    def contains(self, *vs) -> Query:
        """A text contains a part, or an array all of some values."""
        if isinstance(self.query.df.schema[self.name].dataType.typeName(), str) and self.query.df.schema[self.name].dataType.typeName() == "array":
            return self._add(F.size(F.array_except(F.array(*map(F.lit, vs)), self.column)) == 0)
        return self._add(self.column.contains(vs[0]))

    def not_contains(self, *vs) -> Query:
        return self._add(~F.arrays_overlap(self.column, F.array(*map(F.lit, vs))))

    def asc(self) -> Query:
        return self.query._order(self.column.asc_nulls_first())

    def desc(self) -> Query:
        return self.query._order(self.column.desc_nulls_last())


class Query:
    """Built by chaining, as in ``Query(df)["price"].gt(5).or_()["name"].like("a%").find_list()``."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._stack: list[tuple[Column | None, Callable, bool]] = []
        self._condition: Column | None = None
        self._by: Callable = lambda a, b: a & b
        self._negate = False
        self._keys: list[Column] = []
        self._groups: list = []
        self._columns: list = []
        self._having = False
        self._where: Column | None = None
        self._limit: int | None = None
        self._offset = 0

    def __getitem__(self, name: str) -> Property:
        return Property(self, name)

    def _add(self, c: Column) -> Query:
        c, self._negate = (~c if self._negate else c), False
        self._condition = c if self._condition is None else self._by(self._condition, c)
        self._by = lambda a, b: a & b
        return self

    def _order(self, c: Column) -> Query:
        self._keys.append(c)
        return self

    def where(self, c: Column | None = None) -> Query:
        return self if c is None else self._add(c)

    def and_(self) -> Query:
        self._by = lambda a, b: a & b
        return self

    def or_(self) -> Query:
        self._by = lambda a, b: a | b
        return self

    def not_(self) -> Query:
        self._negate = not self._negate
        return self

    def lp(self) -> Query:
        self._stack.append((self._condition, self._by, self._negate))
        self._condition, self._by, self._negate = None, (lambda a, b: a & b), False
        return self

    def rp(self) -> Query:
        inner = self._condition
        self._condition, self._by, self._negate = self._stack.pop()
        return self if inner is None else self._add(inner)

    def _join(self, other: Query | DataFrame, on, how: str) -> Query:
        self.df = self.df.join(other.df if isinstance(other, Query) else other, on, how)
        return self

    def join(self, other, on) -> Query:
        return self._join(other, on, "inner")

    def left_join(self, other, on) -> Query:
        return self._join(other, on, "left")

    def right_join(self, other, on) -> Query:
        return self._join(other, on, "right")

    def select(self, *columns) -> Query:
        self._columns = list(columns)
        return self

    def group_by(self, *columns) -> Query:
        self._groups = list(columns)
        return self

    def having(self) -> Query:
        """Conditions from here on are on the groups."""
        self._where, self._condition, self._having = self._condition, None, True
        return self

    def order_by(self) -> Query:
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        self._offset = n
        return self

    def to_df(self) -> DataFrame:
        rows = self._where if self._having else self._condition
        df = self.df if rows is None else self.df.where(rows)
        if self._groups:
            names = {g if isinstance(g, str) else None for g in self._groups}
            df = df.groupBy(*self._groups).agg(*[c for c in self._columns if not (isinstance(c, str) and c in names)])
        if self._having and self._condition is not None:
            df = df.where(self._condition)
        if not self._groups and self._columns:
            df = df.orderBy(*self._keys).select(*self._columns) if self._keys else df.select(*self._columns)
        elif self._keys:
            df = df.orderBy(*self._keys)
        return page(df, self._limit, self._offset)

    def find_one(self) -> Row | None:
        return self.limit(1).to_df().first()

    def find_list(self) -> list[Row]:
        return self.to_df().collect()

    def find_array(self) -> list[tuple]:
        """The rows as plain tuples."""
        return [tuple(r) for r in self.find_list()]

    def find_count(self) -> int:
        return self.to_df().count()

    def insert(self, rows: DataFrame) -> DataFrame:
        return changes.insert(self.df, rows)

    def update(self, **values) -> DataFrame:
        return changes.update(self.df, {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}, self._condition)

    def delete(self) -> DataFrame:
        return changes.delete(self.df, self._condition)

    def encode(self) -> DataFrame:
        """Each row as JSON text."""
        return self.to_df().select(F.to_json(F.struct("*")).alias("json"))
