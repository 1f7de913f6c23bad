"""Column types and definitions, and the rules of inserted rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import types as T

#: The eleven column types and Spark's. JSON and ARRAY are JSON texts.
TYPES: dict[str, T.DataType] = {
    "INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "BOOL": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
    "STRING": T.StringType(), "BYTES": T.BinaryType(), "JSON": T.StringType(), "ARRAY": T.StringType(), "NULL": T.StringType(),
}
ROW_ID = "_row_id"


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "STRING"
    nullable: bool = True
    default: Any = None
    primary_key: bool = False
    unique: bool = False
    auto_increment: bool = False
    indexed: bool = False

    def field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.type], True, {k: v for k, v in asdict(self).items() if k not in ("name", "type") and v not in (None, False)})

    def encode(self, value: Any) -> Any:
        """A value as it is stored."""
        if value is None:
            return None
        if self.type in ("JSON", "ARRAY"):
            return value if isinstance(value, str) else json.dumps(value, default=str)
        if self.type == "STRING":
            return value if isinstance(value, str) else str(value)
        if self.type == "BYTES":
            return bytearray(value.encode() if isinstance(value, str) else value)
        if self.type == "TIMESTAMP":
            if isinstance(value, int | float):
                value = datetime.fromtimestamp(value / 1000)
            return value.replace(microsecond=value.microsecond // 1000 * 1000)
        if self.type == "NULL":
            return None
        if self.type in ("FLOAT32", "FLOAT64"):
            return float(value)
        return bool(value) if self.type == "BOOL" else int(value)


def struct(columns: list[Column]) -> T.StructType:
    return T.StructType([c.field() for c in columns])


def stored(columns: list[Column]) -> T.StructType:
    return T.StructType([T.StructField(ROW_ID, T.LongType()), *struct(columns).fields])


def complete(columns: list[Column], row: dict[str, Any], auto: int) -> dict[str, Any]:
    """The stored row: explicit value, auto-increment, default, error if not nullable, null. Unknown keys are dropped."""
    out = {}
    for c in columns:
        if c.name in row:
            out[c.name] = c.encode(row[c.name])
        elif c.auto_increment:
            out[c.name] = auto
        elif c.default is not None:
            out[c.name] = c.encode(c.default)
        elif not c.nullable:
            raise ValueError(f"column {c.name} must have a value")
        else:
            out[c.name] = None
    return out


def column_of(spec: dict[str, Any]) -> Column:
    return Column(**spec)


def spec_of(c: Column) -> dict[str, Any]:
    return asdict(c)
