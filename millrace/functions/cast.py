"""Typed casts with errors told apart from nulls, constraints, and what to do with rows that fail.

Policies: ``raise`` stops the job, ``drop`` leaves out the row, ``clear`` makes the field null, ``ignore`` keeps what can be kept
(a typed column can't hold text that doesn't fit, so that is null), or a function of (resource, row, index, error[, field]) that says
whether to keep the row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..schema import from_spark, spark_type
from .text import col, python_time_pattern

#: Defaults of the table schema standard.
TRUE, FALSE = ("true", "True", "TRUE", "1"), ("false", "False", "FALSE", "0")


def raise_exception(*_):  # noqa: ANN002, ANN201
    return "raise"


def ignore(*_):  # noqa: ANN002, ANN201
    return "ignore"


def drop(*_):  # noqa: ANN002, ANN201
    return "drop"


def clear(*_):  # noqa: ANN002, ANN201
    return "clear"


_POLICIES = {raise_exception: "raise", ignore: "ignore", drop: "drop", clear: "clear"}


def policy(on_error: object) -> str | Callable:
    if on_error is None:
        return "ignore"
    if isinstance(on_error, str):
        if on_error not in ("raise", "ignore", "drop", "clear"):
            raise ValueError(f"unknown policy {on_error!r}")
        return on_error
    return _POLICIES.get(on_error, on_error)


def _by_pattern(c: Column, pattern: str) -> Column:
    """A text as a timestamp; null where it doesn't fit. Years of two digits from 69 on are of the last century, as in Python."""
    found = F.try_to_timestamp(c, F.lit(python_time_pattern(pattern)))
    return F.when(F.year(found) > 2068, found - F.make_ym_interval(F.lit(100))).otherwise(found) if "%y" in pattern else found


def _from_text(c: Column, field: dict) -> Column:
    """A text as a value of the field's type; null where it doesn't fit."""
    kind, form = field["type"], field.get("format", "default")
    if kind in ("integer", "number"):
        if field.get("bareNumber") is False:
            c = F.regexp_replace(c, r"^[^\d+-]+|[^\d]+$" if kind == "integer" else r"^[^\d.,+-]+|[^\d.,]+$", "")
        if group := field.get("groupChar"):
            c = F.replace(c, F.lit(group), F.lit(""))
        if (point := field.get("decimalChar", ".")) != ".":
            c = F.replace(c, F.lit(point), F.lit("."))
        c = F.trim(c)
        if kind == "integer":
            return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))
        fits = c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf)$")
        return F.when(fits, c.try_cast(spark_type("number", field)))
    if kind == "boolean":
        return F.when(c.isin(*field.get("trueValues", TRUE)), True).when(c.isin(*field.get("falseValues", FALSE)), False)
    if kind == "date":
        if form not in ("default", "any"):
            return F.to_date(_by_pattern(c, form))
        return F.when(c.rlike(r"^\d{4}-\d\d?-\d\d?$"), c.try_cast("date"))
    if kind == "datetime":
        if form not in ("default", "any"):
            return _by_pattern(c, form).cast("timestamp_ntz")
        return F.when(c.rlike(r"^\d{4}-\d\d?-\d\d?([T ]\d\d?:\d\d(:\d\d(\.\d+)?)?Z?)?$"), F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz"))
    if kind == "time":
        if form not in ("default", "any"):
            return F.date_format(F.try_to_timestamp(c, F.lit(python_time_pattern(form))), "HH:mm:ss")
        return F.when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$"), F.when(F.length(c) == 5, F.concat(c, F.lit(":00"))).otherwise(c))
    if kind == "year":
        return F.when(c.rlike(r"^\d{1,4}$"), c.try_cast("int"))
    if kind == "yearmonth":
        return F.when(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), c)
    if kind == "geopoint":
        pair = F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ",")
        return F.when((F.size(pair) == 2) & F.forall(pair, lambda x: x.try_cast("double").isNotNull()), F.transform(pair, lambda x: x.try_cast("double")))
    if kind in ("array", "object", "geojson"):
        kind_of = F.schema_of_variant(F.try_parse_json(c))
        return F.when(kind_of.startswith("ARRAY" if kind == "array" else "OBJECT"), c)
    if kind == "duration":
        day = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
        part = lambda i: F.coalesce(F.regexp_extract(c, day, i).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
        return F.when(c.rlike(day) & (F.length(c) > 1), F.make_dt_interval(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), part(4)))
    return c


def typed(c: Column, now: T.DataType, field: dict, missing: Iterable[str] = ("",)) -> tuple[Column, Column]:
    """The value as the field's type, and whether it fails to be one or breaks a constraint."""
    kind, target = field["type"], spark_type(field["type"], field)
    given = c.isNotNull()
    text = isinstance(now, T.StringType)
    if text:
        gone = F.coalesce(c.isin(*missing), F.lit(False)) if list(missing) else F.lit(False)
        given = given & ~gone
        value = F.when(given, _from_text(c, field))
    elif kind == "any":
        value = c.cast("string") if isinstance(now, T.AtomicType) else F.to_json(c)
    elif kind == "string":
        value = F.lit(None).cast("string")
    elif kind == "integer":
        whole = isinstance(now, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        value = c.cast("long") if whole else F.when(c == F.floor(c), c.cast("long")) if isinstance(now, T.NumericType) else F.lit(None).cast("long")
    elif kind == "number":
        value = c.cast(target) if isinstance(now, T.NumericType) else F.lit(None).cast(target)
    elif kind == "year":
        value = c.cast("int") if isinstance(now, T.NumericType) else F.lit(None).cast("int")
    elif kind == "date":
        value = c if isinstance(now, T.DateType) else F.lit(None).cast("date")
    elif kind == "datetime":
        value = c.cast("timestamp_ntz") if isinstance(now, (T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("timestamp_ntz")
    elif kind == "geopoint":
        value = c.cast("array<double>") if isinstance(now, T.ArrayType) else F.lit(None).cast("array<double>")
    elif kind in ("array", "object", "geojson"):
        value = F.to_json(c) if isinstance(now, (T.ArrayType, T.MapType, T.StructType)) else F.lit(None).cast("string")
    else:
        value = c if now == target else F.lit(None).cast(target)
    bad = given & value.isNull()
    rules = field.get("constraints") or {}
    checks = [F.lit(False)]
    if rules.get("required"):
        checks.append(value.isNull())
    for name, fails in (("minimum", lambda v, x: v < x), ("maximum", lambda v, x: v > x)):
        if name in rules:
            checks.append(fails(value, F.lit(rules[name]).cast(target)))
    if "minLength" in rules:
        checks.append(F.length(value) < rules["minLength"])
    if "maxLength" in rules:
        checks.append(F.length(value) > rules["maxLength"])
    if "pattern" in rules:
        checks.append(~value.rlike(f"^(?:{rules['pattern']})$"))
    if "enum" in rules:
        checks.append(~value.isin(*rules["enum"]))
    broken = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in checks])
    return value, bad | broken


def guard(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``df``, failing on bad rows that reach this place; neither pruned away nor moved to where other steps drop rows."""
    # an expression that isn't deterministic keeps the filter where it is; it is never true
    never = F.spark_partition_id() < 0
    return df.filter(F.when(never, F.lit(True)).when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def cast_fields(df: DataFrame, fields: list[dict], missing: Iterable[str], on_error: object, resource: str = "") -> DataFrame:
    """``df`` with the fields cast, and failures treated by the policy."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values, bad = {}, {}
    for f in fields:
        values[f["name"]], bad[f["name"]] = typed(col(f["name"]), kinds[f["name"]], f, missing)
    return apply_policy(df, values, bad, on_error, resource)


def apply_policy(df: DataFrame, values: dict[str, Column], bad: dict[str, Column], on_error: object, resource: str) -> DataFrame:
    how = policy(on_error)
    names = df.columns
    if not bad:
        return df
    any_bad = reduce(lambda a, b: a | b, bad.values())
    pick = lambda extra=(): df.select(*[values[n].alias(n) if n in values else col(n) for n in names], *extra)
    if how == "ignore":
        return df.select(*[values[n].alias(n) if n in values else col(n) for n in names])
    if how == "clear":
        return df.select(*[F.when(~bad[n], values[n]).alias(n) if n in values else col(n) for n in names])
    if how == "drop":
        return df.filter(~any_bad).select(*[values[n].alias(n) if n in values else col(n) for n in names])
    faults = F.concat_ws(", ", *[F.when(b, F.concat(F.lit(f"{n}="), F.coalesce(col(n).cast("string") if isinstance(df.schema[n].dataType, T.AtomicType) else F.to_json(col(n)), F.lit("null")))) for n, b in bad.items()])
    if how == "raise":
        return guard(df, any_bad, F.concat(F.lit(f"ValidationError in resource {resource}: "), faults)).select(*[values[n].alias(n) if n in values else col(n) for n in names])
    return _by_function(pick([F.filter(F.array(*[F.when(b, n) for n, b in bad.items()]), lambda x: x.isNotNull()).alias("__errors")]), names, how, resource)


def _by_function(df: DataFrame, names: list[str], handler: Callable, resource: str) -> DataFrame:
    """Rows with errors go through the user's function, in Arrow batches; rows without aren't turned into Python objects."""
    import inspect

    width = len(inspect.signature(handler).parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = 0
        for batch in batches:
            keep = []
            for i, errors in enumerate(batch.column(len(names)).to_pylist()):
                ok = True
                if errors:
                    row = {n: from_spark(batch.column(k)[i].as_py(), "") for k, n in enumerate(names)}
                    for e in errors:
                        error = ValidationError(resource, row, index + i, e)
                        ok = bool(handler(*(resource, row, index + i, error, e)[:width])) and ok
                keep.append(ok)
            index += batch.num_rows
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name in names]))


def strip_text(c: Column) -> Column:
    """Without the white space around, as Python knows it."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$", "")


def anchored(pattern: str, regex: bool) -> re.Pattern:
    return re.compile(f"^(?:{pattern})$" if regex else f"^{re.escape(pattern)}$")
