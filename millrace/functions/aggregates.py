"""The aggregators of lookup joins and groupings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..package import ORDER

#: Aggregators and the logical type of their results (None: the source's).
AGGREGATES: dict[str, str | None] = {
    "sum": None, "avg": "number", "median": "number", "max": None, "min": None, "first": None, "last": None,
    "any": None, "count": "integer", "set": "array", "array": "array", "counters": "array",
}
ORDERED = frozenset(("first", "last", "any", "array", "counters"))


def in_order(value: Column) -> Column:
    """Values that aren't null, in arrival order."""
    gathered = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(ORDER).alias("o"), value.alias("v")))))
    return F.transform(gathered, lambda x: x["v"])


def aggregate(name: str, value: Column, kind: T.DataType) -> Column:
    """An aggregate expression. Nulls are skipped, but by ``count``, which counts rows."""
    text = isinstance(kind, T.StringType)
    if name == "sum":
        return F.array_join(F.reverse(in_order(value)), "") if text else F.sum(value)
    if name == "avg":
        return F.avg(value)
    if name == "median":
        return F.median(value)
    if name == "max":
        return F.max(value)
    if name == "min":
        return F.min(value)
    if name == "count":
        return F.count(F.lit(1))
    if name == "set":
        return F.sort_array(F.collect_set(value))
    if name == "array":
        return in_order(value)
    given = F.when(value.isNotNull(), F.col(ORDER))
    if name == "first":
        return F.min_by(value, given)
    if name in ("last", "any"):
        return F.max_by(value, given)
    raise ValueError(f"unknown aggregator {name!r}; there are {sorted(AGGREGATES)}")
