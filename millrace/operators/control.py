"""Control: branches, callbacks, checkpoints, parallel row functions, printing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import functions as F

from ..flow import Context, Flow, Step, map_rows, with_order
from ..package import ORDER, Package, Resource, select
from ..schema import TableSchema


def conditional(predicate: Callable[[Package], bool], flow: Any) -> Step:
    """A flow, or a function of the package that gives one, taken if the predicate holds for the package as planned."""

    def plan(package: Package, c: Context) -> Package:
        if not predicate(package):
            return package
        return (flow if isinstance(flow, Flow) else flow(package)).plan(package, c.ordered, c.spark)

    needs = isinstance(flow, Flow) and any(s.needs_order for s in flow._links())
    return Step("conditional", plan, needs_order=needs)


def finalizer(callback: Callable) -> Step:
    """A callback after the run; it gets the merged stats if it takes a parameter ``stats``."""
    return Step("finalizer", lambda p, c: p.with_(finalizers=(*p.finalizers, callback)))


class _Checkpoint(Step):
    def __init__(self, name: str, path: str, resources: Any, steps: list[Step] | None):
        self.label, self.path, self.resources, self.steps = name, f"{path.rstrip('/')}/{name}", resources, steps
        super().__init__("checkpoint", self._plan, needs_order=False)

    def wrap(self, before: list[Step]) -> _Checkpoint:
        """The checkpoint that stands for itself and all that precedes it."""
        steps = [*before, *(self.steps or [])]
        made = _Checkpoint(self.label, self.path.rsplit("/", 1)[0], self.resources, steps)
        made.needs_order = any(s.needs_order for s in steps)
        return made

    def _plan(self, package: Package, c: Context) -> Package:
        found = _read_text(c, f"{self.path}/package.json")
        if found is None:
            made = package
            for s in self.steps or []:
                made = s.plan(made, c)
            kept = [r for r in made.resources if r.name in select(made, self.resources)]
            for i, r in enumerate(kept):
                r = with_order(r)
                r.df.write.mode("overwrite").parquet(f"{self.path}/{i}")
            described = [{**r.descriptor, "ordered": True} for r in kept]
            # the descriptor comes last: without it there is no checkpoint
            found = json.dumps({"metadata": made.metadata, "resources": described}, default=str)
            _write_text(c, f"{self.path}/package.json", found)
        data = json.loads(found)
        out = Package(metadata=data["metadata"])
        for i, d in enumerate(data["resources"]):
            rest = {k: v for k, v in d.items() if k not in ("name", "schema", "ordered")}
            out = out.add(Resource(d["name"], c.spark.read.parquet(f"{self.path}/{i}"), TableSchema.from_descriptor(d["schema"]), rest, True))
        return out


def _read_text(c: Context, path: str) -> str | None:
    jvm, conf = c.spark._jvm, c.spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return None
    return c.spark.read.text(path, wholetext=True).first()[0]


def _write_text(c: Context, path: str, text: str) -> None:
    """Written beside and renamed, so that a reader sees all or nothing."""
    jvm, conf = c.spark._jvm, c.spark._jsc.hadoopConfiguration()
    p, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = p.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(beside, p)


def checkpoint(checkpoint_name: str, checkpoint_path: str = ".checkpoints", steps: Any = None, resources: Any = None) -> Step:
    """Results of all steps before, written once as Parquet and read in later runs instead of running them."""
    return _Checkpoint(checkpoint_name, checkpoint_path, resources, Flow(*steps)._links() if steps else None)


def parallelize(row_func: Callable, num_processors: int | None = None, resources: Any = None, predicate: Callable | None = None) -> Step:
    """A function that changes rows in place, over partitions in parallel. A row for which it fails stays as it was; failures are counted
    in the stats under ``parallelize_errors`` (again where a task runs again). Rows keep their arrival order where it is known."""

    def plan(package: Package, c: Context) -> Package:
        failed = c.spark.sparkContext.accumulator(0)

        def change(r: Resource) -> Resource:
            def run(rows: Iterator[dict]) -> Iterator[dict]:
                for row in rows:
                    if predicate is None or predicate(row):
                        before = dict(row)
                        try:
                            row_func(row)
                        except Exception:  # noqa: BLE001
                            failed.add(1)
                            row = before
                    yield row

            if num_processors:
                r = r.with_(df=r.df.repartition(num_processors))
            return r.with_(df=map_rows(r, run))

        return package.change(resources, change).with_(stats=(*package.stats, {"parallelize_errors": lambda: failed.value}))

    return Step("parallelize", plan)


def printer(
    num_rows: int = 10, last_rows: int | None = None, fields: list[str] | None = None, resources: Any = None, header_print: Callable | None = None, table_print: Callable = print, max_cell_size: int = 100, **_: Any
) -> Step:
    """Prints the first and last rows of resources, cells cut to a size, in jobs of their own."""
    last = num_rows if last_rows is None else last_rows

    def plan(package: Package, _: Context) -> Package:
        for r in package.resources:
            if r.name not in select(package, resources):
                continue
            o = with_order(r)
            names = [n for n in r.schema.names if not fields or n in fields]
            head = o.df.orderBy(ORDER).limit(num_rows).collect()
            tail = o.df.orderBy(F.desc(ORDER)).limit(last).collect()[::-1]
            seen = {row[ORDER] for row in head}
            rows = head + [row for row in tail if row[ORDER] not in seen]
            (header_print or table_print)(f"{r.name}:")
            table_print(_table([names, *[[_cell(row[n], max_cell_size) for n in names] for row in rows]]))
        return package

    return Step("printer", plan)


def _cell(v: Any, size: int) -> str:
    text = str(v)
    return text if len(text) <= size else text[: size - 3] + "..."


def _table(rows: list[list[str]]) -> str:
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


