"""Lookup joins and groupings.

A join groups its source by the key, aggregates fields, and looks each target row up. Keys of plain fields of equal types are
compared as they are, null equal to null; other keys by their text forms.
"""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Context, Step, with_order
from ..functions.aggregates import AGGREGATES, ORDERED, aggregate
from ..functions.text import Template, col, key_columns
from ..package import ORDER, Package, Resource
from ..schema import TableSchema, spark_type
from ..staging import staged

_KEY = "__key"


def _specs(fields: dict | list, source: Resource) -> dict[str, dict]:
    """Target names with their source and aggregator; ``*`` stands for all source fields that aren't mentioned."""
    given = {k: None for k in fields} if isinstance(fields, (list, tuple)) else dict(fields)
    out = {}
    for target, spec in given.items():
        if target != "*":
            out[target] = {"name": target, "aggregate": "any", **(spec or {})}
    if "*" in given:
        mentioned = {s["name"] for s in out.values()} | set(out)
        for n in source.schema.names:
            if n not in mentioned:
                out[n] = {"name": n, "aggregate": "any", **{k: v for k, v in (given["*"] or {}).items() if k != "name"}}
    for t, s in out.items():
        if s["aggregate"] not in AGGREGATES:
            raise ValueError(f"unknown aggregator {s['aggregate']!r} for {t}")
        if s["aggregate"] != "count" and s["name"] not in source.schema.names:
            raise ValueError(f"{source.name} has no field {s['name']!r}")
    order = {n: i for i, n in enumerate(source.schema.names)}
    names = sorted(out, key=lambda t: (0, order[out[t]["name"]], t) if out[t]["name"] in order and out[t]["name"] == t else (1, 0, t)) if "*" in given else list(out)
    return {t: out[t] for t in names}


def _field(target: str, spec: dict, source: Resource) -> dict:
    name, how = spec["name"], spec["aggregate"]
    if how == "count":
        return {"name": target, "type": "integer"}
    f = source.schema.field(name)
    kind = AGGREGATES[how] or f["type"]
    kept = {k: v for k, v in f.items() if k not in ("name", "type", "constraints")} if how in ("median", "first", "last", "any") else {}
    return {**kept, "name": target, "type": kind}


def _plain(key: Any) -> list[str] | None:
    """The fields of a key that is made of whole fields."""
    if isinstance(key, (list, tuple)):
        return None if "#" in key else list(key)
    t = Template(key)
    if [p[0] for p in t.parts if p[0]] == [] and all(n and not spec for _, n, spec, _ in t.parts) and len(t.parts) == 1:
        return None if t.fields == ["#"] else list(t.fields)
    return None


def _uses_number(key: Any) -> bool:
    return "#" in (key if isinstance(key, (list, tuple)) else Template(key).fields)


def numbered(r: Resource) -> Resource:
    """The resource with dense row numbers from 1 in ``__number``.

    Order ids grow by partition, so the rows of each partition that gave them are counted; the counts' running sum, a row for each
    partition, is broadcast, and rows are numbered within theirs. The rows are staged first, as both passes must see the same ids.
    """
    r = with_order(r)
    df = staged(r.df, "numbered").withColumn("__at", F.shiftright(ORDER, 33))
    counts = df.groupBy("__at").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__at", (F.sum("__n").over(Window.orderBy("__at")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__at").orderBy(ORDER))
    return r.with_(df=df.withColumn("__in", within).join(F.broadcast(before), "__at").withColumn("__number", F.col("__in") + F.col("__before")).drop("__at", "__in", "__before"))


def _key_fields(key: Any) -> list[str]:
    """The fields that a key is made of, in order."""
    return list(key) if isinstance(key, (list, tuple)) else Template(key).fields


def _grouped(source: Resource, keys: list[Column], specs: dict[str, dict], key_fields: list[str], carried: list[str] | None = None) -> DataFrame:
    """One row for each key, with the aggregates under their target names and the carried fields of its rows as ``__carry0`` ..."""
    kinds = {f.name: f.dataType for f in source.df.schema.fields}
    key_names = [f"{_KEY}{i}" for i in range(len(keys))]
    counters = {t: s for t, s in specs.items() if s["aggregate"] == "counters"}
    medians = {t: s for t, s in specs.items() if s["aggregate"] == "median" and isinstance(kinds[s["name"]], T.NumericType)}
    df = source.df.withColumns({n: k for n, k in zip(key_names, keys, strict=True)})
    aggregates = []
    for t, s in specs.items():
        if t in counters or t in medians:
            continue
        if s["aggregate"] in ("any", "first", "last", "min", "max") and s["name"] in key_fields:
            continue  # constant in each group
        kind = kinds.get(s["name"], T.LongType())
        value = aggregate(s["aggregate"], col(s["name"]) if s["aggregate"] != "count" else F.lit(1), kind)
        aggregates.append(_stored(value, _field(t, s, source), s["aggregate"]).alias(t))
    carried = carried or []
    aggregates += [F.max(col(n)).alias(f"__carry{i}") for i, n in enumerate(carried)]
    out = df.groupBy(*key_names).agg(*aggregates) if aggregates else df.select(*key_names).distinct()
    for t, s in specs.items():
        if t not in out.columns and t not in counters and t not in medians:
            out = out.withColumn(t, F.col(key_names[key_fields.index(s["name"])]))
    for t, s in counters.items():
        out = _same_keys(out, _counted(df, key_names, s["name"], kinds[s["name"]], t), key_names, "left")
    for t, s in medians.items():
        out = _same_keys(out, _median(df, key_names, s["name"], t), key_names, "left")
    return out.select(*key_names, *[col(t) for t in specs], *[F.col(f"__carry{i}") for i in range(len(carried))])


#: The median's place is first bounded by approximate percentiles of this accuracy.
_ACCURACY = 10_000


def _median(df: DataFrame, keys: list[str], name: str, target: str) -> DataFrame:
    """The exact median for each key. No task gathers a key's values.

    Approximate percentiles bound it: their rank error is a row in ``_ACCURACY`` at most. Smaller values are counted, and only the distinct
    values within the bounds are put in order, with their counts.
    """
    rows = df.select(*keys, col(name).alias("__v")).where("__v is not null")
    near = 2 / _ACCURACY
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", [0.5 - near, 0.5 + near], _ACCURACY).alias("__p"))
    bounds = bounds.select(*keys, "__n", F.col("__p")[0].alias("__low"), F.col("__p")[1].alias("__high"))
    both = _same_keys(rows, bounds, keys, "inner").where("__v <= __high")
    inside = F.col("__v") >= F.col("__low")
    each = both.groupBy(*keys, F.when(inside, F.col("__v")).alias("__v"), "__n").agg(F.count(F.lit(1)).alias("__c"))  # null: all smaller ones
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()))
    placed = each.select(*keys, "__v", "__n", upto.alias("__upto"), (upto - F.col("__c")).alias("__before"))
    at = lambda rank: F.max(F.when((F.col("__before") < rank) & (rank <= F.col("__upto")), F.col("__v")))
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    return placed.groupBy(*keys).agg(((at(low).cast("double") + at(high).cast("double")) / 2).alias(target))


def _stored(value: Column, field: dict, how: str) -> Column:
    """Arrays are held as JSON text; other results as their type's."""
    if how in ("set", "array"):
        return F.to_json(value)
    if field["type"] in ("any", "array", "object", "geojson"):
        return value
    return value.cast(spark_type(field["type"], field))


def _counted(df: DataFrame, keys: list[str], name: str, kind: T.DataType, target: str) -> DataFrame:
    """(value, count) pairs, most common first, ties by first appearance; lists count their elements."""
    values = df.select(*keys, ORDER, (F.explode(col(name)) if isinstance(kind, T.ArrayType) else col(name)).alias("v")).where("v is not null")
    if isinstance(kind, T.StringType):
        listed = F.from_json("v", "array<string>")
        values = values.select(*keys, ORDER, F.explode(F.when(F.col("v").startswith("["), F.coalesce(listed, F.array("v"))).otherwise(F.array("v"))).alias("v"))
    each = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("o"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o", "v")))
    text = F.transform(pairs, lambda x: F.concat(F.lit("["), F.to_json(F.array(x["v"])).substr(F.lit(2), F.length(F.to_json(F.array(x["v"]))) - 2), F.lit(","), (-x["m"]).cast("string"), F.lit("]")))
    return each.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias(target))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"{k}_r"))
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"{k}_r" for k in keys])


def _mode(full: Any, mode: str) -> str:
    if full is not None:
        warnings.warn("full= is deprecated; use mode=", DeprecationWarning, stacklevel=3)
        return "half-outer" if full else "inner"
    if mode not in ("half-outer", "inner", "full-outer", "semi", "anti"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode


def join(
    source_name: str, source_key: Any, target_name: str, target_key: Any, fields: Any = None, full: Any = None, mode: str = "half-outer", source_delete: bool = True
) -> Step:
    """Aggregates of the source rows of equal key put into each target row.

    Modes: ``half-outer`` keeps target rows without a match, ``inner`` drops them, ``full-outer`` adds a row for each source key without a
    target; ``semi`` and ``anti`` keep target rows with or without a match and add nothing. The key field ``#`` is the row number.
    """
    fields = {} if fields is None else fields
    mode = _mode(full, mode)

    def plan(package: Package, c: Context) -> Package:
        names = package.names
        if source_name not in names or target_name not in names or names.index(source_name) >= names.index(target_name):
            raise ValueError(f"the source {source_name!r} must stand before the target {target_name!r}; there are {names}")
        source, target = package[source_name], package[target_name]
        specs = _specs(fields, source)
        if any(s["aggregate"] in ORDERED for s in specs.values()):
            source = with_order(source)
        s_names, t_names = _plain(source_key), _plain(target_key)
        s_kinds, t_kinds = ({f.name: f.dataType for f in r.df.schema.fields} for r in (source, target))
        if s_names and t_names and len(s_names) == len(t_names) and all(_comparable(s_kinds[a], t_kinds[b]) for a, b in zip(s_names, t_names, strict=True)):
            s_keys, t_keys = [col(n) for n in s_names], [col(n) for n in t_names]
        else:
            if _uses_number(source_key):
                source = numbered(source)
            if _uses_number(target_key):
                target = numbered(target)
            s_keys, t_keys = [key_columns(source_key, s_kinds, F.col("__number"))], [key_columns(target_key, t_kinds, F.col("__number"))]
            s_names = t_names = None
        # keys that are compared as text: what an added row gets in the target's key fields
        pairs = [(a, b) for a, b in zip(_key_fields(source_key), _key_fields(target_key), strict=False) if "#" not in (a, b)] if mode == "full-outer" and not s_names else []
        grouped = _grouped(source, s_keys, specs, s_names or [], [a for a, _ in pairs])
        carried = {b: F.col(f"__carry{i}") for i, (_, b) in enumerate(pairs)}
        key_names = [f"{_KEY}{i}" for i in range(len(s_keys))]
        schema = target.schema.copy()
        for t, s in specs.items():
            f = _field(t, s, source)
            if t not in schema.names:
                schema.fields.append(f)
            elif schema.field(t)["type"] != f["type"]:
                raise ValueError(f"{t} is {schema.field(t)['type']} in {target_name}, not {f['type']}")
        df = target.df.withColumns(dict(zip(key_names, t_keys, strict=True)))
        if mode in ("semi", "anti") or mode == "inner" and not specs:
            df = _semi(df, grouped, key_names, mode == "anti")
            joined = df.select(*[col(n) for n in target.schema.names], *([ORDER] if target.ordered else []))
            schema = target.schema
        else:
            right = grouped.select(*[F.col(k).alias(f"{k}_r") for k in key_names], *[col(t).alias(f"__new_{i}") for i, t in enumerate(specs)], *[F.col(f"__carry{i}") for i in range(len(pairs))], F.lit(True).alias("__hit"))
            on = _on(key_names)
            how = {"half-outer": "left", "inner": "inner", "full-outer": "full"}[mode]
            both = df.withColumn("__there", F.lit(True)).join(right, on, how)
            new = {t: F.col(f"__new_{i}") for i, t in enumerate(specs)}
            columns = []
            for n in schema.names:
                if n in new:
                    old = col(n) if n in target.schema.names else None
                    columns.append((F.when(F.col("__hit"), new[n]).otherwise(old) if old is not None else new[n]).cast(spark_type(schema.field(n)["type"], schema.field(n))).alias(n))
                elif mode == "full-outer" and t_names and n in t_names:
                    columns.append(F.coalesce(col(n), F.col(f"{_KEY}{t_names.index(n)}_r")).alias(n))
                elif n in carried:
                    columns.append(F.when(F.col("__there"), col(n)).otherwise(carried[n].try_cast(t_kinds[n])).alias(n))
                else:
                    columns.append(col(n))
            # source keys without a target come last, in the order of their keys
            order = [F.coalesce(F.col(ORDER), F.lit(1 << 62)).alias(ORDER)] if target.ordered else []
            joined = both.select(*columns, *order)
        out = target.with_(df=joined, schema=schema)
        resources = [out if r.name == target_name else r for r in package.resources if not (source_delete and r.name == source_name)]
        return package.with_(resources=tuple(resources))

    return Step("join", plan, needs_order=_needs_order(fields) or _uses_number(source_key) or _uses_number(target_key))


def _on(key_names: list[str]) -> Column:
    on = None
    for k in key_names:
        c = F.col(k).eqNullSafe(F.col(f"{k}_r"))
        on = c if on is None else on & c
    return on


def _semi(df: DataFrame, grouped: DataFrame, key_names: list[str], anti: bool) -> DataFrame:
    right = grouped.select(*[F.col(k).alias(f"{k}_r") for k in key_names])
    return df.join(right, _on(key_names), "left_anti" if anti else "left_semi")


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return a == b or isinstance(a, whole) and isinstance(b, whole)


def _needs_order(fields: Any) -> bool:
    if isinstance(fields, (list, tuple)):
        return bool(fields)
    return any((s or {}).get("aggregate", "any") in ORDERED for s in fields.values())


def join_with_self(resource_name: str, join_key: Any, fields: Any) -> Step:
    """One row for each key, in the order of keys, with aggregates, in the resource's place."""

    def plan(package: Package, c: Context) -> Package:
        r = package[resource_name]
        specs = _specs(fields, r)
        names = _plain(join_key) or []
        if any(s["aggregate"] in ORDERED and s["name"] not in names for s in specs.values()):
            r = with_order(r)
        kinds = {f.name: f.dataType for f in r.df.schema.fields}
        if _uses_number(join_key):
            r = numbered(r)
        keys = [col(n) for n in names] if names else [key_columns(join_key, kinds, F.col("__number"))]
        grouped = _grouped(r, keys, specs, names)
        schema = TableSchema([_field(t, s, r) for t, s in specs.items()])
        cast = lambda t: col(t).cast(spark_type(schema.field(t)["type"], schema.field(t))).alias(t)
        columns = [cast(t) for t in specs]
        if c.ordered:
            grouped = grouped.orderBy(*[F.col(f"{_KEY}{i}").cast("string") for i in range(len(keys))]).withColumn(ORDER, F.monotonically_increasing_id())
            columns.append(F.col(ORDER))
        out = r.with_(df=grouped.select(*columns), schema=schema, ordered=c.ordered)
        return package.with_(resources=tuple(out if x.name == resource_name else x for x in package.resources))

    in_key = set(_plain(join_key) or [])
    given = {k: None for k in fields} if isinstance(fields, (list, tuple)) else fields
    ordered = any((s or {}).get("aggregate", "any") in ORDERED and (s or {}).get("name", t) not in in_key for t, s in given.items())
    return Step("join_with_self", plan, needs_order=ordered)


def join_self(source_name: str, source_key: Any, target_name: str, fields: Any) -> Step:
    """An older form of ``join_with_self`` that also renames the resource."""

    def plan(package: Package, c: Context) -> Package:
        package = join_with_self(source_name, source_key, fields).plan(package, c)
        return package.change([source_name], lambda r: r.with_(name=target_name))

    return Step("join_self", plan, needs_order=join_with_self(source_name, source_key, fields).needs_order)
