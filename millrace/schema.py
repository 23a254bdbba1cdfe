"""Logical column types, table schemas and inference from Python rows."""

from __future__ import annotations

import copy
import datetime as dt
import decimal
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import types as T

#: Values of these types are held as JSON text in a column; they are decoded when rows leave the engine.
JSON_TYPES = frozenset(("any", "array", "object", "geojson"))
SAMPLE_ROWS = 100

_SPARK: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "time": T.StringType(),
    "duration": T.DayTimeIntervalType(),
    "year": T.IntegerType(),
    "yearmonth": T.StringType(),
    "geopoint": T.ArrayType(T.DoubleType()),
    "any": T.StringType(),
    "array": T.StringType(),
    "object": T.StringType(),
    "geojson": T.StringType(),
}


def spark_type(logical: str, field: dict | None = None) -> T.DataType:
    """The Spark type that holds values of a logical type; ``decimal`` in the field asks for exact numbers."""
    if logical == "number" and field and field.get("decimal"):
        return T.DecimalType(38, 18)
    if logical not in _SPARK:
        raise ValueError(f"unknown type {logical!r}")
    return _SPARK[logical]


def logical_type(kind: T.DataType) -> str:
    """The logical type of a Spark column that has no declared one."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.DayTimeIntervalType):
        return "duration"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.MapType, T.StructType, T.VariantType)):
        return "object"
    return "string"


class TableSchema:
    """Fields (dicts with name, type and any properties), primary key, missing values and other properties."""

    def __init__(self, fields: Iterable[dict] = (), primary_key: Iterable[str] = (), missing_values: Iterable[str] = ("",), **properties: Any):
        self.fields = [dict(f) for f in fields]
        self.primary_key, self.missing_values, self.properties = list(primary_key), list(missing_values), properties

    @classmethod
    def of(cls, kind: T.StructType) -> TableSchema:
        return cls([{"name": f.name, "type": logical_type(f.dataType)} for f in kind.fields])

    @property
    def names(self) -> list[str]:
        return [f["name"] for f in self.fields]

    def field(self, name: str) -> dict:
        return next(f for f in self.fields if f["name"] == name)

    def copy(self) -> TableSchema:
        return copy.deepcopy(self)

    @property
    def descriptor(self) -> dict:
        out: dict = {"fields": copy.deepcopy(self.fields), "missingValues": list(self.missing_values), **copy.deepcopy(self.properties)}
        if self.primary_key:
            out["primaryKey"] = list(self.primary_key)
        return out

    @classmethod
    def from_descriptor(cls, d: dict) -> TableSchema:
        key = d.get("primaryKey") or []
        rest = {k: v for k, v in d.items() if k not in ("fields", "primaryKey", "missingValues")}
        return cls(d.get("fields", []), [key] if isinstance(key, str) else key, d.get("missingValues", [""]), **rest)


def infer_type(values: Iterable[Any]) -> str:
    """The one type of all values that aren't null, else ``any``."""
    kinds = {_kind(v) for v in values if v is not None}
    return kinds.pop() if len(kinds) == 1 else "any"


def _kind(v: Any) -> str:
    for types, name in (
        (bool, "boolean"), (str, "string"), (int, "integer"), ((float, decimal.Decimal), "number"), ((list, tuple), "array"), (dict, "object"),
        (dt.datetime, "datetime"), (dt.date, "date"), (dt.time, "time"), (dt.timedelta, "duration"), (set, "array"),
    ):
        if isinstance(v, types):
            return name
    return "any"


def infer_rows(rows: list[dict]) -> TableSchema:
    """Columns of the first row, each typed by a sample."""
    sample = rows[:SAMPLE_ROWS]
    return TableSchema([{"name": n, "type": infer_type(r.get(n) for r in sample)} for n in (rows[0] if rows else {})])


def plain(v: Any) -> Any:
    """A JSON form of a value within an object or array."""
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return v.total_seconds()
    if isinstance(v, set):
        return sorted((plain(x) for x in v), key=str)
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def to_spark(v: Any, logical: str) -> Any:
    """A Python value as its column holds it. Values that don't fit their type raise ``ValueError``."""
    if v is None:
        return None
    if logical in JSON_TYPES:
        return json.dumps(plain(v), ensure_ascii=False)
    try:
        if logical == "number":
            return float(v)
        if logical == "integer":
            if isinstance(v, (bool, str)) or int(v) != v:
                raise ValueError
            return int(v)
        if logical in ("string", "yearmonth"):
            return v if isinstance(v, str) else str(v)
        if logical == "time":
            return v.isoformat() if isinstance(v, dt.time) else str(v)
        if logical == "geopoint":
            return [float(x) for x in (v.split(",") if isinstance(v, str) else v)]
        if logical == "boolean" and not isinstance(v, bool):
            raise ValueError
    except (TypeError, ValueError, OverflowError):
        raise ValueError(f"{v!r} is no {logical}") from None
    return v


def from_spark(v: Any, logical: str, decimals: bool = False) -> Any:
    """The Python value of a column's value."""
    if v is None:
        return None
    if logical in JSON_TYPES and isinstance(v, str):
        try:
            return json.loads(v)
        except ValueError:
            return v
    if logical == "time" and isinstance(v, str):
        try:
            return dt.time.fromisoformat(v)
        except ValueError:
            return v
    if isinstance(v, T.Row):
        return {k: from_spark(x, "") for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [from_spark(x, "") for x in v]
    return v
