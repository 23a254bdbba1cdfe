"""Row operators: filters, validation, sorting, limits, duplicates, concatenation."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Context, Step, with_order
from ..functions.cast import apply_policy, cast_fields, policy
from ..functions.text import Template, col, python_text
from ..package import ORDER, Package, Resource, select
from ..schema import TableSchema, spark_type, to_spark
from .columns import row_udf, step


def filter_rows(condition: Any = None, resources: Any = None, equals: Any = (), not_equals: Any = ()) -> Step:
    """Rows for which a Column, SQL text or function of the row is true; or that equal any of ``equals``, or differ from any of ``not_equals``.

    Without any condition no row stays.
    """

    def change(r: Resource, _: Context) -> Resource:
        if condition is not None:
            keep = condition if isinstance(condition, Column) else F.expr(condition) if isinstance(condition, str) else row_udf(condition, r, T.BooleanType(), "any_bool")
        else:
            fits = lambda k, v: col(k).eqNullSafe(F.lit(to_spark(v, r.schema.field(k)["type"])))
            tests = [fits(k, v) for e in equals for k, v in e.items()] + [~fits(k, v) for e in not_equals for k, v in e.items()]
            keep = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        return r.with_(df=r.df.filter(keep))

    return step("filter_rows", resources, change)


def validate(*args: Any, resources: Any = None, on_error: Any = "raise") -> Step:
    """Rows checked against the schema; by a predicate of the row; or a field by a predicate of its value. Columns serve as predicates."""

    def change(r: Resource, _: Context) -> Resource:
        if not args:
            return r.with_(df=cast_fields(r.df, r.schema.fields, r.schema.missing_values, on_error, r.name))
        if len(args) == 1:
            test, names = args[0], r.schema.names[:1]
            passes = test if isinstance(test, Column) else row_udf(lambda row: bool(test(row)), r, T.BooleanType(), "any_bool")
        else:
            name, test = args
            names = [name]
            passes = test if isinstance(test, Column) else row_udf(lambda row: bool(test(row[name])), r, T.BooleanType(), "any_bool")
        bad = {names[0]: ~F.coalesce(passes, F.lit(False))}
        how = policy(on_error)
        values = {names[0]: col(names[0])}
        if how == "clear":
            values[names[0]] = F.when(~bad[names[0]], col(names[0]))
        return r.with_(df=apply_policy(r.df, values, bad, on_error, r.name))

    return step("validate", resources, change)


def limit_rows(count: int, resources: Any = None) -> Step:
    """The first rows."""
    return step("limit_rows", resources, lambda r, _: first_rows(r, count), needs_order=True)


def first_rows(r: Resource, count: int) -> Resource:
    if not count:
        return r
    return r.with_(df=r.df.orderBy(ORDER).limit(count) if r.ordered else r.df.limit(count))


def _sort_columns(key: Any, r: Resource) -> list[Column]:
    kinds = {f.name: f.dataType for f in r.df.schema.fields}
    if callable(key) and not isinstance(key, Column):
        return [row_udf(lambda row: str(key(row)), r, T.StringType(), "string")]
    if isinstance(key, Column):
        return [key]
    if isinstance(key, (list, tuple)):
        template = Template("".join("{%s}" % k for k in key))
    else:
        template = Template(key)
    out: list[Column] = []
    for _, name, spec, _ in template.parts:
        if name is None:
            continue
        if not spec and isinstance(kinds[name], T.NumericType):
            # a null sorts behind zero and negative numbers and before positive ones, as its text form does among their keys
            out += [F.when(col(name).isNull(), 1).when(col(name) <= 0, 0).otherwise(2), col(name)]
        else:
            out.append(template.field_text(name, spec, kinds[name]))
    return out


def sort_rows(key: Any, resources: Any = None, reverse: bool = False, batch_size: int = 1000) -> Step:
    """Rows by a key: field names, a template, a Column or a function of the row. Ties keep their order; ``reverse`` reverses all.

    ``batch_size`` is accepted and has no effect.
    """

    def change(r: Resource, c: Context) -> Resource:
        by = _sort_columns(key, r)
        if c.ordered:
            r = with_order(r)
            by = [*by, F.col(ORDER)]
        df = r.df.orderBy(*[b.desc() if reverse else b.asc() for b in by])
        if c.ordered:  # places in the sorted order; ids grow over range partitions
            df = df.withColumn(ORDER, F.monotonically_increasing_id())
        return r.with_(df=df)

    return step("sort_rows", resources, change)


def deduplicate(resources: Any = None) -> Step:
    """The first row of each primary key; a resource without one stays."""

    def change(r: Resource, c: Context) -> Resource:
        key = r.schema.primary_key
        if not key:
            return r
        if not c.ordered:
            return r.with_(df=r.df.dropDuplicates(key))
        r = with_order(r)
        if len(key) == len(r.schema.names):
            first = r.df.groupBy(*[col(k) for k in key]).agg(F.min(ORDER).alias(ORDER))
            return r.with_(df=first.select(*[col(n) for n in r.schema.names], ORDER))
        # each partition keeps one row a key before the shuffle (the window's group limit), so copies of a key don't meet in one task
        place = F.row_number().over(Window.partitionBy(*[col(k) for k in key]).orderBy(ORDER))
        return r.with_(df=r.df.withColumn("__place", place).where("__place = 1").drop("__place"))

    return step("deduplicate", resources, change, needs_order=True)


def duplicate(source: Any = None, target_name: str | None = None, target_path: str | None = None, batch_size: int = 1000, duplicate_to_end: bool = False) -> Step:
    """A copy of a resource behind it or at the end. ``batch_size`` is accepted and has no effect."""

    def plan(package: Package, _: Context) -> Package:
        name = next((n for n in package.names if n in select(package, source)), None) if source is not None else package.names[0]
        if name is None:
            raise ValueError(f"no resource {source!r}")
        copy = package[name].with_(name=target_name or f"{name}_copy")
        copy = copy.with_(properties={**copy.properties, "path": target_path or f"{copy.name}.csv"})
        out = list(package.resources)
        out.insert(len(out) if duplicate_to_end else package.names.index(name) + 1, copy)
        return package.with_(resources=tuple(out))

    return Step("duplicate", plan)


def concatenate(fields: dict[str, list[str]], target: dict | None = None, resources: Any = None) -> Step:
    """One resource from several that stand together, with fields mapped; each target takes the last of its sources that isn't null."""
    target = {"name": "concat", "path": "data/concat.csv", **(target or {})}

    def plan(package: Package, c: Context) -> Package:
        chosen = [n for n in package.names if n in select(package, resources)]
        if not chosen:
            raise ValueError("no resources to concatenate")
        at = [package.names.index(n) for n in chosen]
        if at != list(range(at[0], at[0] + len(at))):
            raise ValueError("resources to concatenate must stand together")
        mapping: dict[str, str] = {}
        for t, sources in fields.items():
            for s in [t, *(x for x in sources if x != t)]:
                if mapping.setdefault(s, t) != t:
                    raise ValueError(f"{s} is mapped to {mapping[s]} and to {t}")
        typed_by: dict[str, dict] = {}
        keys: list[str] = []
        parts = []
        for i, n in enumerate(chosen):
            r = package[n]
            r = with_order(r) if c.ordered else r
            for f in r.schema.fields:
                if f["name"] in mapping:
                    typed_by.setdefault(mapping[f["name"]], {**f, "name": mapping[f["name"]]})
            keys += [mapping[k] for k in r.schema.primary_key if k in mapping and mapping[k] not in keys]
            parts.append((i, r))
        schema = TableSchema([typed_by.get(t, {"name": t, "type": "string"}) for t in fields], keys)
        union = None
        for i, r in parts:
            kinds = {f.name: f.dataType for f in r.df.schema.fields}
            columns = []
            for f in schema.fields:
                kind = spark_type(f["type"], f)
                sources = [s for s in r.schema.names if mapping.get(s) == f["name"]]
                values = [col(s) if kinds[s] == kind or not isinstance(kind, T.StringType) else python_text(col(s), kinds[s], None) for s in reversed(sources)]
                columns.append((F.coalesce(*values) if values else F.lit(None)).cast(kind).alias(f["name"]))
            df = r.df.select(*columns, *([(F.col(ORDER) + F.lit(i * (1 << 52))).alias(ORDER)] if c.ordered else []))
            union = df if union is None else union.unionByName(df)
        made = Resource(target["name"], union, schema, {k: v for k, v in target.items() if k != "name"}, c.ordered)
        out = [r for r in package.resources if r.name not in chosen]
        out.insert(at[0], made)
        return package.with_(resources=tuple(out))

    return Step("concatenate", plan)

