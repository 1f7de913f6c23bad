"""An immutable query builder that compiles to one DataFrame plan.

Order of clauses: filter, aggregate, sort, offset, limit, project, distinct (last, so a limit comes
before it). ``or_where`` makes one OR of all conditions of the open group; groups nest.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.predicates import Op, combined, operator, predicate


@dataclass(frozen=True)
class Condition:
    column: str
    op: Op | str
    value: object = None


@dataclass(frozen=True)
class Group:
    kind: str = "AND"
    negated: bool = False
    parts: tuple[Condition | Group, ...] = ()

    def column(self, schema: T.StructType, strict_like: bool = False) -> Column:
        kinds = {f.name: f.dataType for f in schema}

        def one(part: Condition | Group) -> Column:
            if isinstance(part, Group):
                return part.column(schema, strict_like)
            known = part.column in kinds
            kind = kinds.get(part.column, T.NullType())
            return predicate(F.col(f"`{part.column}`") if known else F.lit(None), kind, part.op, part.value, strict_like)

        return combined(self.kind, [one(p) for p in self.parts], self.negated)


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False
    nulls_first: bool | None = None

    def by(self) -> Column:
        """Nulls last ascending, first descending, unless nulls_first says so."""
        column = F.col(f"`{self.column}`")
        first = self.descending if self.nulls_first is None else self.nulls_first
        if self.descending:
            return column.desc_nulls_first() if first else column.desc_nulls_last()
        return column.asc_nulls_first() if first else column.asc_nulls_last()


@dataclass(frozen=True)
class Aggregation:
    function: str
    column: str
    alias: str | None = None

    def expression(self, known: list[str]) -> Column:
        name = self.alias or f"{self.function.upper()}_{self.column}"
        if self.column == "*":
            return F.count("*").alias(name)
        column = F.col(f"`{self.column}`") if self.column in known else F.lit(None)
        return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[self.function.upper()](column).alias(name)


@dataclass(frozen=True)
class Query:
    table: str = ""
    columns: tuple[str, ...] = ()
    groups: tuple[Group, ...] = (Group(),)
    orders: tuple[Order, ...] = ()
    row_limit: int | None = None
    row_offset: int = 0
    unique: bool = False
    keys: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()

    def select(self, *columns: str) -> Query:
        return replace(self, columns=self.columns + columns)

    def select_all(self) -> Query:
        return replace(self, columns=())

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def _add(self, part: Condition | Group, kind: str | None = None) -> Query:
        top = self.groups[-1]
        top = replace(top, kind=kind or top.kind, parts=(*top.parts, part))
        return replace(self, groups=(*self.groups[:-1], top))

    def where(self, column: str, op: Op | str, value: object = None) -> Query:
        return self._add(Condition(column, operator(op), value))

    and_where = where

    def or_where(self, column: str, op: Op | str, value: object = None) -> Query:
        """All conditions of the open group so far, or this one."""
        return self._add(Condition(column, operator(op), value), "OR")

    def group_start(self, kind: str = "AND", negated: bool = False) -> Query:
        return replace(self, groups=(*self.groups, Group(kind.upper(), negated)))

    def group_end(self) -> Query:
        if len(self.groups) < 2:
            raise ValueError("no group is open")
        return replace(self, groups=self.groups[:-1])._add(self.groups[-1])

    def all_of(self, *parts: Condition | Group) -> Query:
        return self._add(Group("AND", parts=parts))

    def any_of(self, *parts: Condition | Group) -> Query:
        return self._add(Group("OR", parts=parts))

    def where_eq(self, c, v):
        return self.where(c, Op.EQ, v)

    def where_ne(self, c, v):
        return self.where(c, Op.NE, v)

    def where_lt(self, c, v):
        return self.where(c, Op.LT, v)

    def where_le(self, c, v):
        return self.where(c, Op.LE, v)

    def where_gt(self, c, v):
        return self.where(c, Op.GT, v)

    def where_ge(self, c, v):
        return self.where(c, Op.GE, v)

    def where_in(self, c, v):
        return self.where(c, Op.IN, v)

    def where_not_in(self, c, v):
        return self.where(c, Op.NOT_IN, v)

    def where_like(self, c, v):
        return self.where(c, Op.LIKE, v)

    def where_null(self, c):
        return self.where(c, Op.IS_NULL)

    def where_not_null(self, c):
        return self.where(c, Op.IS_NOT_NULL)

    def where_between(self, c, low, high):
        return self.where(c, Op.BETWEEN, (low, high))

    def where_contains(self, c, v):
        return self.where(c, Op.CONTAINS, v)

    def where_starts_with(self, c, v):
        return self.where(c, Op.STARTS_WITH, v)

    def where_ends_with(self, c, v):
        return self.where(c, Op.ENDS_WITH, v)

    def where_regex(self, c, v):
        return self.where(c, Op.REGEX, v)

    def order_by(self, column: str, direction: str = "ASC", nulls_first: bool | None = None) -> Query:
        if direction.upper() not in ("ASC", "DESC"):
            raise ValueError(f"{direction} is not ASC or DESC")
        return replace(self, orders=(*self.orders, Order(column, direction.upper() == "DESC", nulls_first)))

    def order_by_asc(self, column: str) -> Query:
        return self.order_by(column)

    def order_by_desc(self, column: str) -> Query:
        return self.order_by(column, "DESC")

    def limit(self, n: int) -> Query:
        return replace(self, row_limit=n)

    def offset(self, n: int) -> Query:
        return replace(self, row_offset=n)

    def paginate(self, page: int, per_page: int) -> Query:
        """Pages count from 1."""
        return self.limit(per_page).offset((page - 1) * per_page)

    def group_by(self, *columns: str) -> Query:
        return replace(self, keys=self.keys + columns)

    def _aggregate(self, function: str, column: str, alias: str | None) -> Query:
        return replace(self, aggregations=(*self.aggregations, Aggregation(function, column, alias)))

    def count(self, column: str = "*", alias: str | None = None) -> Query:
        return self._aggregate("COUNT", column, alias)

    def sum(self, column: str, alias: str | None = None) -> Query:
        return self._aggregate("SUM", column, alias)

    def avg(self, column: str, alias: str | None = None) -> Query:
        return self._aggregate("AVG", column, alias)

    def min(self, column: str, alias: str | None = None) -> Query:
        return self._aggregate("MIN", column, alias)

    def max(self, column: str, alias: str | None = None) -> Query:
        return self._aggregate("MAX", column, alias)

    def condition(self, schema: T.StructType, strict_like: bool = False) -> Column | None:
        """The filter, or None if there is no condition. Open groups are closed."""
        query = self
        while len(query.groups) > 1:
            query = query.group_end()
        return query.groups[0].column(schema, strict_like) if query.groups[0].parts else None

    def execute(self, df: DataFrame, strict_compat: bool = False, strict_like: bool = False) -> DataFrame:
        """The plan over df. strict_compat: sort, limit, projection and distinct are ignored beside
        aggregations, and keys without aggregations."""
        where = self.condition(df.schema, strict_like)
        out = df if where is None else df.filter(where)
        if self.aggregations:
            made = [a.expression(df.columns) for a in self.aggregations]
            keys = [F.col(f"`{k}`") if k in df.columns else F.lit(None).alias(k) for k in self.keys]
            out = out.groupBy(*keys).agg(*made) if keys else out.agg(*made)
            if strict_compat:
                return out
        elif self.keys and not strict_compat:
            out = out.select(*[f"`{k}`" for k in self.keys]).distinct()
        if self.orders:
            out = out.orderBy(*[o.by() for o in self.orders if o.column in out.columns])
        if self.row_offset:
            out = out.offset(self.row_offset)
        if self.row_limit is not None:
            out = out.limit(self.row_limit)
        if self.columns and "*" not in self.columns:
            out = out.select(*[F.col(f"`{c}`") if c in out.columns else F.lit(None).alias(c) for c in self.columns])
        return out.distinct() if self.unique else out


def query(table: str = "") -> Query:
    return Query(table)
