"""The seventeen predicates as Columns.

Two-valued logic: a null operand makes every predicate but IS [NOT] NULL false. At the top of a
filter a bare comparison does that already and can be pushed into the Parquet scan; ``two_valued``
wraps it where a NOT stands above.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Op(Enum):
    EQ = "="
    NE = "!="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="
    IN = "IN"
    NOT_IN = "NOT IN"
    LIKE = "LIKE"
    NOT_LIKE = "NOT LIKE"
    IS_NULL = "IS NULL"
    IS_NOT_NULL = "IS NOT NULL"
    BETWEEN = "BETWEEN"
    CONTAINS = "CONTAINS"
    STARTS_WITH = "STARTS WITH"
    ENDS_WITH = "ENDS WITH"
    REGEX = "REGEX"


COMPARE: dict[Op, Callable] = {
    Op.EQ: lambda a, b: a == b,
    Op.NE: lambda a, b: a != b,
    Op.LT: lambda a, b: a < b,
    Op.LE: lambda a, b: a <= b,
    Op.GT: lambda a, b: a > b,
    Op.GE: lambda a, b: a >= b,
}
#: Predicates of callers: name -> (column, value) -> Column.
REGISTERED: dict[str, Callable[[Column, object], Column]] = {}


def register_predicate(name: str, predicate: Callable[[Column, object], Column]) -> None:
    REGISTERED[name.upper()] = predicate


def operator(op: Op | str) -> Op | str:
    """The operator of an enum member or text; ValueError if there is none."""
    if isinstance(op, Op):
        return op
    name = op.strip().upper()
    return name if name in REGISTERED else Op(name)


def parse_number(text: str) -> float | int | None:
    """An int, or a float if the text has a point; None of other texts, exponents without a point included."""
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return None


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def like_pattern(pattern: str) -> str:
    """LIKE as an anchored pattern: % any run, _ any character, the rest literally."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return f"(?idu)^{body}$"


def _compare(column: Column, kind: T.DataType, op: Op, value) -> Column:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if isinstance(kind, T.StringType) and number:
        plain = r"^\s*[+-]?[0-9]+\s*$"
        parsed = F.when(column.rlike(plain) | column.contains("."), column.try_cast("double"))
        if op is Op.NE:
            return column.isNotNull() & F.coalesce(parsed != float(value), F.lit(True))
        return COMPARE[op](parsed, float(value))
    if _numeric(kind) and isinstance(value, str):
        parsed_value = parse_number(value)
        if parsed_value is None:
            return column.isNotNull() if op is Op.NE else F.lit(False)
        return COMPARE[op](column, parsed_value)
    return COMPARE[op](column, F.lit(value))


def _same_kind(kind: T.DataType, value, op: Op) -> None:
    text = isinstance(kind, T.StringType)
    if value is not None and not isinstance(kind, T.NullType) and (text != isinstance(value, str)) and (text or _numeric(kind)):
        raise TypeError(f"{op.value} does not convert {value!r} for a column of {kind.simpleString()}")


def predicate(column: Column, kind: T.DataType, op: Op | str, value=None, strict_like: bool = False) -> Column:
    """column op value, by the column's type. null only where the operand is null."""
    op = operator(op)
    if isinstance(op, str):
        return REGISTERED[op](column, value)
    if op is Op.IS_NULL:
        return column.isNull()
    if op is Op.IS_NOT_NULL:
        return column.isNotNull()
    if op in COMPARE:
        return _compare(column, kind, op, value) if value is not None else F.lit(False)
    if op in (Op.IN, Op.NOT_IN):
        values = [v for v in value if v is not None]
        for v in values:
            _same_kind(kind, v, op)
        if op is Op.IN:
            return column.isin(values) if values else F.lit(False)
        return ~column.isin(values) if values else column.isNotNull()
    if op is Op.BETWEEN:
        low, high = value
        _same_kind(kind, low, op)
        _same_kind(kind, high, op)
        return column.between(low, high)
    text = column if isinstance(kind, T.StringType) else column.cast("string")
    if op in (Op.LIKE, Op.NOT_LIKE):
        found = text.rlike(like_pattern(value)) if strict_like else text.ilike(value)
        return found if op is Op.LIKE else ~found
    if op is Op.CONTAINS:
        return text.contains(str(value))
    if op is Op.STARTS_WITH:
        return text.startswith(str(value))
    if op is Op.ENDS_WITH:
        return text.endswith(str(value))
    return text.rlike(value)


def two_valued(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def combined(kind: str, parts: list[Column], negated: bool = False) -> Column:
    """AND, OR or NOT of parts; true without parts. NOT and ``negated`` flip two-valued results."""
    kind = kind.upper()
    if kind not in ("AND", "OR", "NOT"):
        raise ValueError(f"{kind} is not AND, OR or NOT")
    if not parts:
        return F.lit(True)
    joined = reduce((lambda a, b: a | b) if kind == "OR" else (lambda a, b: a & b), parts)
    return ~two_valued(joined) if negated != (kind == "NOT") else joined
