"""Flows: chains of steps that plan lazy DataFrames, and run when results or sinks ask for them."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ProcessorError
from .functions.text import col
from .package import ORDER, Package, Resource
from .schema import JSON_TYPES, TableSchema, from_spark, infer_rows, spark_type, to_spark


def session() -> SparkSession:
    """The active session, or a new one with what the engine relies on."""
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true").getOrCreate()


class Context:
    """What planning knows: the session, and whether a later step needs arrival order."""

    def __init__(self, spark: SparkSession, ordered: bool):
        self.spark, self.ordered = spark, ordered


class Step:
    """A named function of (package, context). ``needs_order``: arrival order must be known when it is planned."""

    def __init__(self, name: str, plan: Callable[[Package, Context], Package], needs_order: bool = False):
        self.name, self.plan, self.needs_order = name, plan, needs_order


class Processor:
    """A step as a class, to be subclassed: its methods change the package, whole resources, or rows (dicts) of the chosen resources.

    ``resources`` chooses the resources; ``process_row`` returns the row, or None to keep it as it is changed in place.
    """

    resources: Any = None
    needs_order = False

    def process_datapackage(self, package: Package) -> Package:
        return package

    def process_resource(self, resource: Resource) -> Resource:
        if type(self).process_row is Processor.process_row:
            return resource
        return resource.with_(df=map_rows(resource, lambda rows: (_or_same(self.process_row(row), row) for row in rows)))

    def process_row(self, row: dict) -> dict | None:
        return row

    def step(self) -> Step:
        return Step(type(self).__name__, lambda p, _: self.process_datapackage(p).change(self.resources, self.process_resource), needs_order=self.needs_order)


def with_order(r: Resource) -> Resource:
    """The resource with arrival order; one that has lost it counts as being in the order of its partitions."""
    return r if r.ordered else r.with_(df=r.df.withColumn(ORDER, F.monotonically_increasing_id()), ordered=True)


class PackageWrapper:
    """What a package function gets: the descriptor to edit in ``pkg``, and the resources by iteration."""

    def __init__(self, package: Package):
        self.pkg = package
        self._resources = package.resources

    def __iter__(self) -> Iterator[Resource]:
        return iter(self._resources)


class Flow:
    """A chain of steps: operators, other flows, iterables of rows, DataFrames, and functions of row, rows or package."""

    def __init__(self, *steps: Any):
        self.steps = steps

    # planning

    def _links(self) -> list[Step]:
        """Steps in order; a checkpoint takes in what stands before it."""
        out: list[Step] = []
        for s in self.steps:
            for link in s._links() if isinstance(s, Flow) else [self._link(s, len(out))]:
                out = [link.wrap(out)] if hasattr(link, "wrap") else [*out, link]
        return out

    @staticmethod
    def _link(s: Any, position: int) -> Step:
        if isinstance(s, Step):
            return s
        if isinstance(s, Processor):
            return s.step()
        if isinstance(s, DataFrame):
            return Step("dataframe", lambda p, c: p.add(from_dataframe(s, f"res_{len(p.resources) + 1}", c.ordered)))
        if callable(s):
            names = list(inspect.signature(s).parameters)
            kinds = {"row": row_function, "rows": rows_function, "package": package_function}
            if len(names) != 1 or names[0] not in kinds:
                raise TypeError(f"a function in a flow takes one parameter, named row, rows or package; {getattr(s, '__name__', s)} takes {names}")
            return kinds[names[0]](s)
        if isinstance(s, Iterable) and not isinstance(s, (str, bytes, dict)):
            return Step("iterable", lambda p, c: p.add(from_rows(c.spark, s, f"res_{len(p.resources) + 1}", c.ordered)))
        raise TypeError(f"{s!r} can't be a step of a flow")

    def plan(self, package: Package | None = None, ordered: bool = False, spark: SparkSession | None = None) -> Package:
        """The package that the steps make; nothing runs but what schemas need."""
        links = self._links()
        ordered = ordered or any(s.needs_order for s in links)
        context = Context(spark or session(), ordered)
        package = package or Package()
        for position, s in enumerate(links, 1):
            try:
                package = s.plan(package, context)
            except ProcessorError:
                raise
            except Exception as e:
                raise ProcessorError(e, s.name, position) from e
        return package

    def datastream(self) -> Package:
        return self.plan()

    def dataframe(self, name: str | None = None) -> DataFrame:
        """A resource's rows as a DataFrame (the last one, unless named)."""
        package = self.plan()
        return (package[name] if name else package.resources[-1]).rows

    # running

    def results(self, on_error: Any = "raise") -> tuple[list[list[dict]], Package, dict]:
        """All rows of all resources in order, the package, and the merged stats."""
        package = self.plan(ordered=True)
        try:
            rows = [collect(r) for r in package.resources]
        except Exception as e:
            raise ProcessorError(e, "results", len(self._links()) + 1) from e
        stats = finish(package)
        return rows, package, stats

    def process(self) -> tuple[Package, dict]:
        """Run what the flow's sinks write, and every resource that no sink has materialised."""
        package = self.plan()
        for r in package.resources:
            if not r.properties.get("_written"):
                r.df.write.format("noop").mode("overwrite").save()
        return package, finish(package)


def finish(package: Package) -> dict:
    stats: dict = {}
    for s in package.stats:
        stats |= {k: v() if callable(v) else v for k, v in s.items()}
    for f in package.finalizers:
        f(stats) if "stats" in inspect.signature(f).parameters else f()
    return stats


def collect(r: Resource) -> list[dict]:
    """A resource's rows as dicts, in arrival order."""
    kinds = {f["name"]: f["type"] for f in r.schema.fields}
    ordered = r.df.orderBy(ORDER) if r.ordered else r.df
    rows = ordered.select(*[col(n) for n in r.schema.names]).collect()
    return [{n: from_spark(v, kinds[n]) for n, v in zip(r.schema.names, row, strict=True)} for row in rows]


def from_dataframe(df: DataFrame, name: str, ordered: bool = False) -> Resource:
    """A DataFrame as a resource. Its order, where needed, is that of its partitions."""
    return Resource(name, df.withColumn(ORDER, F.monotonically_increasing_id()) if ordered else df, TableSchema.of(df.schema), ordered=ordered)


def from_rows(spark: SparkSession, source: Iterable, name: str, ordered: bool = True, schema: TableSchema | None = None) -> Resource:
    """Python rows, all dicts or all sequences, as a resource."""
    rows = list(source)
    if rows and not all(isinstance(r, dict) for r in rows):
        if any(isinstance(r, dict) or not isinstance(r, (list, tuple)) for r in rows):
            raise TypeError("rows must be all dicts or all sequences")
        width = len(rows[0])
        rows = [{f"col{i}": v for i, v in enumerate(r[:width])} for r in rows]
    schema = schema or infer_rows(rows)
    fields = schema.fields
    kind = T.StructType([T.StructField(f["name"], spark_type(f["type"], f)) for f in fields] + [T.StructField(ORDER, T.LongType())])
    data = [(*(to_spark(r.get(f["name"]), f["type"]) for f in fields), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, kind)
    return Resource(name, df, schema, {"path": f"{name}.csv"}, True)


# user functions


def row_function(f: Callable, resources: Any = None) -> Step:
    """A function of a row (a dict), which it changes or whose successor it returns; the schema stays."""

    def plan(package: Package, _: Context) -> Package:
        def change(r: Resource) -> Resource:
            return r.with_(df=map_rows(r, lambda rows: (_or_same(f(row), row) for row in rows)))

        return package.change(resources, change)

    return Step(getattr(f, "__name__", "row"), plan)


def _or_same(new: dict | None, row: dict) -> dict:
    return row if new is None else new


def map_rows(r: Resource, f: Callable[[Iterator[dict]], Iterable[dict]], per_row: bool = True) -> DataFrame:
    """A partition's rows through a Python function, in Arrow batches. ``per_row``: each row gives one, so batches suffice."""
    fields = [(x["name"], x["type"]) for x in r.schema.fields]
    names = [n for n, _ in fields]
    schema = T.StructType([r.df.schema[n] for n in names] + ([T.StructField(ORDER, T.LongType())] if r.ordered else []))
    carried = [ORDER] if r.ordered else []

    def arrow(rows: list[dict], orders: list[int]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = [[to_spark(x.get(n), t) if t in JSON_TYPES and not isinstance(x.get(n), str) else x.get(n) for x in rows] for n, t in fields]
        kinds = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip([*columns, *([orders] if carried else [])], kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if per_row:
            for batch in batches:
                rows = [{n: from_spark(x[n], t) for n, t in fields} for x in batch.to_pylist()]
                yield arrow(list(f(iter(rows))), batch.column(len(names)).to_pylist() if carried else [])
        else:
            out, count = [], 0
            for row in f({n: from_spark(x[n], t) for n, t in fields} for batch in batches for x in batch.to_pylist()):
                out.append(row)
                if len(out) == 1000:
                    yield arrow(out, list(range(count, count + 1000)))
                    count, out = count + 1000, []
            yield arrow(out, list(range(count, count + len(out))))

    return r.df.select(*[col(n) for n in names], *carried).mapInArrow(run, schema)


def rows_function(f: Callable, resources: Any = None, partitionable: bool = False) -> Step:
    """A generator over a resource's rows in order. It sees all rows, so one task runs it, unless it is partitionable."""

    def plan(package: Package, _: Context) -> Package:
        def change(r: Resource) -> Resource:
            if not partitionable:
                r = with_order(r)
                r = r.with_(df=r.df.coalesce(1).sortWithinPartitions(ORDER))
                return r.with_(df=map_rows(r, f, per_row=False))
            r = r.with_(ordered=False)
            return r.with_(df=map_rows(r, f, per_row=False))

        return package.change(resources, change)

    return Step(getattr(f, "__name__", "rows"), plan, needs_order=not partitionable)


def package_function(f: Callable) -> Step:
    """A generator that yields the package (or None to keep it), then resources, DataFrames or rows for each of its resources."""

    def plan(package: Package, context: Context) -> Package:
        wrapper = PackageWrapper(package)
        made = f(wrapper)
        if made is None:
            return wrapper.pkg
        made = iter(made)
        new = next(made, None) or package
        out = []
        for i, x in enumerate(made):
            if isinstance(x, Resource):
                out.append(x)
            elif isinstance(x, DataFrame):
                name = new.resources[i].name if i < len(new.resources) else f"res_{i + 1}"
                out.append(from_dataframe(x, name, context.ordered))
            else:
                declared = new.resources[i] if i < len(new.resources) else None
                out.append(from_rows(context.spark, x, declared.name if declared else f"res_{i + 1}", True, declared.schema if declared else None))
        return new.with_(resources=tuple(out)) if out or new.resources == () else new

    return Step(getattr(f, "__name__", "package"), plan)
