"""Column operators: selection, renaming, computed fields, replacement, types, unpivoting."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Context, Step
from ..functions.cast import anchored, apply_policy, typed
from ..functions.text import Template, col, python_pattern, python_replacement, python_text
from ..package import ORDER, Package, Resource
from ..schema import JSON_TYPES, TableSchema, from_spark, spark_type, to_spark


def step(name: str, resources: Any, change: Callable[[Resource, Context], Resource], needs_order: bool = False) -> Step:
    """A step that changes the chosen resources one by one."""
    return Step(name, lambda p, c: p.change(resources, lambda r: change(r, c)), needs_order)


def rebuilt(r: Resource, columns: list[Column], schema: TableSchema) -> Resource:
    return r.with_(df=r.df.select(*columns, *([ORDER] if r.ordered else [])), schema=schema)


def row_udf(f: Callable, r: Resource, kind: T.DataType, logical: str) -> Column:
    """A function of the whole row as an Arrow-batched expression."""
    fields = [(x["name"], x["type"]) for x in r.schema.fields]

    def call(*values: Any) -> Any:
        return to_spark(f({n: from_spark(v, t) for (n, t), v in zip(fields, values, strict=True)}), logical)

    return F.udf(call, kind, useArrow=True)(*[col(n) for n, _ in fields])


def select_fields(fields: list[str], resources: Any = None, regex: bool = True) -> Step:
    """Fields by patterns, in the patterns' order; at least one must match."""

    def change(r: Resource, _: Context) -> Resource:
        names: list[str] = []
        for p in fields:
            names += [n for n in r.schema.names if anchored(p, regex).match(n) and n not in names]
        if not names:
            raise ValueError(f"no field of {r.name} matches {fields}")
        schema = r.schema.copy()
        schema.fields = [schema.field(n) for n in names]
        return rebuilt(r, [col(n) for n in names], schema)

    return step("select_fields", resources, change)


def delete_fields(fields: list[str], resources: Any = None, regex: bool = True) -> Step:
    """All fields but those that match."""

    def change(r: Resource, _: Context) -> Resource:
        patterns = [anchored(p, regex) for p in fields]
        for p in patterns:
            if not any(p.match(n) for n in r.schema.names):
                warnings.warn(f"delete_fields: {p.pattern} matches no field of {r.name}", stacklevel=2)
        schema = r.schema.copy()
        schema.fields = [f for f in schema.fields if not any(p.match(f["name"]) for p in patterns)]
        return rebuilt(r, [col(n) for n in schema.names], schema)

    return step("delete_fields", resources, change)


def rename_fields(fields: dict[str, str], resources: Any = None, regex: bool = True) -> Step:
    """New names by pattern; targets may refer to groups. The first pattern that matches counts."""

    def change(r: Resource, _: Context) -> Resource:
        new, renamed = {}, []
        for n in r.schema.names:
            for p, target in fields.items():
                pattern = anchored(p, regex)
                if pattern.match(n):
                    new[n] = pattern.sub(target if regex else target.replace("\\", "\\\\"), n)
                    renamed.append(new[n])
                    break
        if len(set(renamed)) < len(renamed):
            raise ValueError(f"several fields of {r.name} would have the same name: {renamed}")
        if not new:
            warnings.warn(f"rename_fields: nothing in {r.name} matches {list(fields)}", stacklevel=2)
        schema = r.schema.copy()
        for f in schema.fields:
            f["name"] = new.get(f["name"], f["name"])
        schema.primary_key = [new.get(k, k) for k in schema.primary_key]
        return rebuilt(r, [col(n).alias(new.get(n, n)) for n in r.schema.names], schema)

    return step("rename_fields", resources, change)


def _put(r: Resource, name: str, value: Column, field: dict) -> Resource:
    """With a field added, or replaced in its place."""
    schema = r.schema.copy()
    if name in schema.names:
        schema.fields = [field if f["name"] == name else f for f in schema.fields]
    else:
        schema.fields.append(field)
    return rebuilt(r, [value.alias(n) if n == name else col(n) for n in schema.names], schema)


def add_field(name: str, type: str, default: Any = None, resources: Any = None, **options: Any) -> Step:  # noqa: A002
    """A field with a constant, a Column, or what a function of the row gives."""

    def change(r: Resource, _: Context) -> Resource:
        field = {"name": name, "type": type, **options}
        kind = spark_type(type, field)
        if isinstance(default, Column):
            value = default.cast(kind)
        elif callable(default):
            value = row_udf(default, r, kind, type)
        else:
            value = F.lit(to_spark(default, type)).cast(kind)
        return _put(r, name, value, field)

    return step("add_field", resources, change)



def _computed_type(operation: Any, source: list[dict]) -> str:
    types = [f["type"] for f in source]
    if "any" in types:
        return "any"
    if operation in ("format", "join"):
        return "string"
    if operation == "avg" or "number" in types:
        return "number"
    return types[0] if types else "any"


def _computed(r: Resource, spec: dict) -> tuple[Column, str]:
    operation = spec["operation"]
    sources = [f for p in spec.get("source") or [] for f in r.schema.fields if anchored(p, True).match(f["name"])] if operation != "format" else []
    names = list(dict.fromkeys(f["name"] for f in sources))
    target = spec["target"]
    declared = target.get("type") if isinstance(target, dict) else None
    logical = declared or _computed_type(operation, [r.schema.field(n) for n in names])
    kinds = {f.name: f.dataType for f in r.df.schema.fields}
    if isinstance(operation, Column):
        return operation, declared or "any"
    if callable(operation):
        return row_udf(operation, r, spark_type(declared or "any"), declared or "any"), declared or "any"
    if operation == "constant":
        value = spec.get("with")
        kind = declared or {bool: "boolean", int: "integer", float: "number", str: "string"}.get(type(value), "any")
        return F.lit(to_spark(value, kind)), kind
    if operation == "format":
        return Template(spec["with"]).column(kinds), declared or "string"
    if operation == "join":
        return F.concat_ws(spec.get("with", ","), *[python_text(col(n), kinds[n], None) for n in names]), declared or "string"
    numbers = [col(n) for n in names]
    if operation in ("sum", "multiply"):  # nulls leave the result as it is
        kind, plus = _kind_of(r, numbers) if numbers else T.LongType(), operation == "sum"
        start = F.lit(0 if plus else 1).cast(kind)
        return reduce(lambda a, x: (a + x if plus else a * x).cast(kind), (F.coalesce(x.cast(kind), start) for x in numbers), start), logical
    if operation == "avg":
        total = reduce(lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)), numbers, F.lit(0.0))
        return total / F.nullif(reduce(lambda a, x: a + x.isNotNull().cast("int"), numbers, F.lit(0)), F.lit(0)), declared or "number"
    if operation in ("max", "min"):
        return ((F.greatest if operation == "max" else F.least)(*numbers) if len(numbers) > 1 else numbers[0] if numbers else F.lit(None)), logical
    raise ValueError(f"unknown operation {operation!r}")


def _kind_of(r: Resource, numbers: list[Column]) -> T.DataType:
    return r.df.select(F.array(*numbers).alias("a")).schema["a"].dataType.elementType


def add_computed_field(*args: Any, resources: Any = None, **spec: Any) -> Step:
    """Fields computed from others: sum, avg, max, min, multiply, constant, join, format, a Column, or a function of the row."""
    specs = [dict(s) for s in (args[0] if args and isinstance(args[0], (list, tuple)) else [args[0]] if args else [spec])]
    if len(args) > 1:
        resources = args[1]

    def change(r: Resource, _: Context) -> Resource:
        for s in specs:
            value, logical = _computed(r, s)
            target = s["target"]
            field = {**target, "type": logical} if isinstance(target, dict) else {"name": target, "type": logical}
            r = _put(r, field["name"], value.cast(spark_type(logical, field)), field)
        return r

    return step("add_computed_field", resources, change)


def find_replace(fields: list[dict], resources: Any = None, keep_nulls: bool = False) -> Step:
    """Patterns replaced in the text forms of fields, one after the other. Null is the text None, unless nulls are kept."""

    def change(r: Resource, _: Context) -> Resource:
        values: dict[str, Column] = {}
        for f in fields:
            name = f["name"]
            kind = r.df.schema[name].dataType
            value = values.get(name, python_text(col(name), kind, None if keep_nulls else "None"))
            for p in f.get("patterns", []):
                value = F.regexp_replace(value, python_pattern(str(p["find"])), python_replacement(str(p["replace"])))
            values[name] = value
        # the declared type stays: what isn't text is cast back
        back = {n: v if isinstance(r.df.schema[n].dataType, T.StringType) else v.try_cast(r.df.schema[n].dataType) for n, v in values.items()}
        return rebuilt(r, [back[n].alias(n) if n in back else col(n) for n in r.schema.names], r.schema)

    return step("find_replace", resources, change)


def set_type(name: str, resources: Any = -1, regex: bool = True, on_error: Any = "raise", transform: Any = None, **options: Any) -> Step:
    """New properties and a cast of all fields that match; by default in the last resource. ``transform`` comes before the cast."""

    def change(r: Resource, _: Context) -> Resource:
        names = [n for n in r.schema.names if anchored(name, regex).match(n)]
        if not names:
            raise ValueError(f"no field of {r.name} matches {name}")
        schema = r.schema.copy()
        df, values, bad = r.df, {}, {}
        for f in schema.fields:
            if f["name"] not in names:
                continue
            old = f["type"]
            f.update(options)
            n = f["name"]
            source, kind = col(n), df.schema[n].dataType
            if transform is not None:
                source, kind = _transformed(r, transform, n, old, f["type"])
            values[n], bad[n] = typed(source, kind, f, schema.missing_values)
        df = apply_policy(df, values, bad, on_error, r.name)
        return r.with_(df=df, schema=schema)

    return step("set_type", resources, change)


def _transformed(r: Resource, transform: Any, name: str, old: str, new: str) -> tuple[Column, T.DataType]:
    if isinstance(transform, Column):
        return transform, r.df.select(transform.alias("t")).schema["t"].dataType
    import inspect

    width = len(inspect.signature(transform).parameters)
    kind = spark_type(new)
    if width == 1:
        return F.udf(lambda v: to_spark(transform(from_spark(v, old)), new), kind, useArrow=True)(col(name)), kind
    return row_udf(lambda row: transform(*(row[name], name, row)[:width]), r, kind, new), kind


def unpivot(unpivot_fields: list[dict], extra_keys: list[dict], extra_value: dict, regex: bool = True, resources: Any = None) -> Step:
    """A row for each of the fields that match, with keys made from their names; nulls stay."""

    def change(r: Resource, _: Context) -> Resource:
        taken: list[tuple[str, dict]] = []
        for spec in unpivot_fields:
            pattern = anchored(spec["name"], regex)
            for n in r.schema.names:
                if n in {t for t, _ in taken} or not pattern.match(n):
                    continue
                keys = {k: pattern.sub(v, n) if regex and isinstance(v, str) else v for k, v in spec["keys"].items()}
                taken.append((n, keys))
        position = {n: i for i, n in enumerate(r.schema.names)}
        taken.sort(key=lambda t: position[t[0]])
        kept = [n for n in r.schema.names if n not in {t for t, _ in taken}]
        if not taken:
            return r
        value_kind, kinds = spark_type(extra_value["type"]), {f.name: f.dataType for f in r.df.schema.fields}
        parts = []
        for n, keys in taken:
            value = col(n)
            if extra_value["type"] in JSON_TYPES and not isinstance(kinds[n], T.StringType):
                value = python_text(col(n), kinds[n], None)
            elif extra_value["type"] in JSON_TYPES and r.schema.field(n)["type"] not in JSON_TYPES:
                value = F.to_json(F.array(col(n)))
                value = F.when(col(n).isNotNull(), F.substring(value, F.lit(2), F.length(value) - 2))
            columns = [_key_value(keys.get(k["name"]), k).alias(k["name"]) for k in extra_keys]
            parts.append(F.struct(*columns, value.cast(value_kind).alias(extra_value["name"])))
        schema = r.schema.copy()
        schema.fields = [f for f in schema.fields if f["name"] in kept] + [dict(k) for k in extra_keys] + [dict(extra_value)]
        extra = [k["name"] for k in extra_keys] + [extra_value["name"]]
        if r.ordered:
            inner = r.df.select(*[col(n) for n in kept], ORDER, F.posexplode(F.array(*parts)).alias("__at", "__part"))
            order = [(col(ORDER) * len(parts) + F.col("__at")).alias(ORDER)]
        else:
            inner, order = r.df.select(*[col(n) for n in kept], F.explode(F.array(*parts)).alias("__part")), []
        return r.with_(df=inner.select(*[col(n) for n in kept], *[F.col("__part").getField(n).alias(n) for n in extra], *order), schema=schema)

    return step("unpivot", resources, change)


def _key_value(v: Any, field: dict) -> Column:
    kind = spark_type(field["type"])
    if isinstance(v, str) and field["type"] not in ("string", *JSON_TYPES):
        value, _ = typed(F.lit(v), T.StringType(), field)
        return value.cast(kind)
    return F.lit(None if v is None else to_spark(v, field["type"])).cast(kind)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
