"""A package as lines: its descriptor, then each resource's rows, with a blank line behind each resource."""

from __future__ import annotations

import codecs
import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import nullcontext
from typing import Any, TextIO

from pyspark.sql import types as T

from ..flow import Context, Step, from_rows, with_order
from ..functions.text import col
from ..package import ORDER, Package, Resource
from ..schema import TableSchema, from_spark, spark_type, to_spark
from ..staging import staged
from . import ejson
from .parts import CHUNK, Parts, in_reach, shared_path

#: Bytes of a file that a task reads.
SPLIT = 32 << 20


def stream(file: Any = sys.stdout) -> Step:
    """Writes the package to a file or a path; tasks write the rows. A path is written beside and renamed when it is whole."""

    def gather(parts: Parts, package: Package) -> None:
        parts.text(ejson.dumps(package.descriptor) + "\n")
        for r in package.resources:
            kinds = {f["name"]: f["type"] for f in r.schema.fields}
            parts.records(r.df.orderBy(ORDER).select(*[col(n) for n in kinds]), _line(kinds))
            parts.text("\n")

    def plan(package: Package, c: Context) -> Package:
        package = package.with_(resources=tuple(with_order(r) for r in package.resources))
        with Parts(c.spark) as parts:
            if isinstance(file, (str, os.PathLike)):
                with open(f"{file}.active", "wb") as out:
                    gather(parts, package)
                    parts.join(out)
                os.replace(f"{file}.active", file)
            else:
                gather(parts, package)
                decoder = codecs.getincrementaldecoder("utf-8")()
                for chunk in parts.chunks():
                    file.write(decoder.decode(chunk))
        return package

    return Step("stream", plan, needs_order=True)


def _line(kinds: dict[str, str]) -> Any:
    return lambda row: (ejson.dumps({n: from_spark(v, kinds[n]) for n, v in zip(kinds, row, strict=True)}) + "\n").encode("utf-8")


def unstream(file: Any = sys.stdin) -> Step:
    """The package that a file or path holds, instead of what there was. Tasks read a path's rows, each some of its bytes."""

    def on_driver(lines: TextIO, c: Context) -> Package:
        descriptor = ejson.loads(lines.readline())
        out = _package(descriptor)
        for d in descriptor["resources"]:
            rows = []
            for line in lines:
                if not line.strip():
                    break
                rows.append(ejson.loads(line))
            out = out.add(_resource(from_rows(c.spark, rows, d["name"], True, TableSchema.from_descriptor(d["schema"])), d))
        return out

    def plan(_: Package, c: Context) -> Package:
        is_path, shared = isinstance(file, (str, os.PathLike)), shared_path(c.spark)
        if is_path and os.path.isfile(file) and in_reach(c.spark, os.fspath(file)):
            return _by_tasks(os.path.abspath(file), c)
        with open(file, encoding="utf-8") if is_path else nullcontext(file) as lines:
            if not shared:
                return on_driver(lines, c)
            os.makedirs(shared, exist_ok=True)
            copy = f"{shared}/millrace-unstream-{uuid.uuid4().hex}"
            try:
                with open(copy, "w", encoding="utf-8", newline="\n") as out:
                    _copy(lines, out)
                return _by_tasks(copy, c)
            finally:
                os.remove(copy)

    return Step("unstream", plan)


def _package(descriptor: dict) -> Package:
    return Package(metadata={k: v for k, v in descriptor.items() if k != "resources"})


def _resource(r: Resource, d: dict) -> Resource:
    return r.with_(properties={k: v for k, v in d.items() if k not in ("name", "schema")})


def _copy(lines: TextIO, out: TextIO) -> None:
    """A package's lines, and none behind them. Line breaks of other kinds are mere white space within a line."""
    first = lines.readline()
    out.write(first.replace("\r", " "))
    left = len(ejson.loads(first)["resources"])
    while left and (line := lines.readline()):
        out.write(line.replace("\r", " "))
        left -= not line.strip()


def _by_tasks(path: str, c: Context) -> Package:
    """Rows are staged, so that they stay if the file is written anew."""
    size = os.path.getsize(path)
    _, start, first = next(_lines(path, 0, 0, 1, size))
    descriptor = ejson.loads(first.decode("utf-8"))
    out, count, context = _package(descriptor), len(descriptor["resources"]), c.spark.sparkContext

    def blank(split: tuple) -> list[tuple[int, int]]:
        """Where the split's first blank lines begin and end, as many as can end a resource."""
        found: list[tuple[int, int]] = []
        for at, behind, line in _lines(*split):
            if len(found) == count:
                break
            if not line.decode("utf-8").strip():
                found.append((at, behind))
        return found

    splits = _splits(path, start, size)
    ends = sorted(context.parallelize(splits, max(len(splits), 1)).flatMap(blank).collect()) if count else []
    ends = [*ends[:count], *[(size, size)] * (count - len(ends))]  # the last blank line may be missing
    for d, (end, behind) in zip(descriptor["resources"], ends, strict=True):
        schema = TableSchema.from_descriptor(d["schema"])
        kind = T.StructType([T.StructField(f["name"], spark_type(f["type"], f)) for f in schema.fields] + [T.StructField(ORDER, T.LongType())])
        splits = _splits(path, start, end)
        rows = context.parallelize(splits, max(len(splits), 1)).flatMap(_reader([(f["name"], f["type"]) for f in schema.fields]))
        df = staged(c.spark.createDataFrame(rows, kind), "unstream")
        out, start = out.add(_resource(Resource(d["name"], df, schema, ordered=True), d)), behind
    return out


def _reader(fields: list[tuple[str, str]]) -> Any:
    """A function of a split that gives its rows, each with its place in the file."""

    def rows(split: tuple) -> Iterator[tuple]:
        for at, _, line in _lines(*split):
            row = ejson.loads(line.decode("utf-8"))
            if isinstance(row, list):
                row = {f"col{i}": v for i, v in enumerate(row)}
            elif not isinstance(row, dict):
                raise TypeError("rows must be all dicts or all sequences")
            yield (*(to_spark(row.get(n), t) for n, t in fields), at)

    return rows


def _splits(path: str, start: int, end: int) -> list[tuple[str, int, int, int, int]]:
    return [(path, start, at, min(at + SPLIT, end), end) for at in range(start, end, SPLIT)]


def _lines(path: str, first: int, start: int, stop: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """Begin, end and text of a split's lines: those that begin from ``start`` to before ``stop``. Lines lie between ``first`` and ``end``."""
    with open(path, "rb", buffering=CHUNK) as f:
        at = start
        if start > first:  # a line that begins before is another split's
            f.seek(start - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(start)
        while at < stop and (line := f.readline()):
            behind = at + len(line)
            pieces = line.removesuffix(b"\n").removesuffix(b"\r").split(b"\r")  # a carriage return ends a line, too
            for i, piece in enumerate(pieces, 1):
                if at >= end:
                    return
                yield at, behind if i == len(pieces) else at + len(piece) + 1, piece
                at += len(piece) + 1
            at = behind
