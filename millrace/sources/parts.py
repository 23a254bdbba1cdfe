"""Files in one piece, made by tasks: each writes its partition's lines to a part in the shared folder, and one task joins the parts.

The driver learns the parts' names and counts, never their lines. A target that tasks can't open is joined by the driver, a chunk at a
time; without a shared folder that Python can open, lines come through the driver, a partition at a time.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..package import ORDER
from ..staging import shared_dir

CHUNK = 1 << 20


def shared_path(spark: SparkSession) -> str | None:
    """The folder that driver and executors share as a path for Python, where there is one."""
    try:
        found = re.sub(r"^file:(//)?(?=/)", "", shared_dir(spark))
    except ValueError:
        return None
    return None if re.match(r"^[\w+.-]+:", found) else os.path.abspath(found)


def in_reach(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open a path of the driver: all run on one machine, or it lies in the shared folder."""
    shared = shared_path(spark)
    return shared is not None and (spark.sparkContext.master.startswith("local") or os.path.realpath(path).startswith(os.path.realpath(shared) + os.sep))


def _part(folder: str, between: bytes, place: int, lines: Iterable[bytes]) -> Iterator[tuple[int, str, int]]:
    """A partition's part: its place, path and number of lines; none if there is no line."""
    path, rows = f"{folder}/{uuid.uuid4().hex}", 0
    with open(path, "wb", buffering=CHUNK) as out:
        for line in lines:
            if rows and between:
                out.write(between)
            out.write(line)
            rows += 1
    if rows:
        yield place, path, rows
    else:
        os.remove(path)


def _chunks(pieces: Iterable[bytes | str]) -> Iterator[bytes]:
    for piece in pieces:
        if isinstance(piece, bytes):
            yield piece
            continue
        with open(piece, "rb") as part:
            while chunk := part.read(CHUNK):
                yield chunk


def _joined(pieces: Iterable[bytes | str], out: Any) -> tuple[int, str]:
    """Bytes and md5 of what is written."""
    size, digest = 0, hashlib.md5()
    for chunk in _chunks(pieces):
        out.write(chunk)
        size += len(chunk)
        digest.update(chunk)
    return size, digest.hexdigest()


def _joined_beside(pieces: list[bytes | str], path: str) -> tuple[str, int, str]:
    """The same to a file of its own, so that a task can be tried again: its path, bytes and md5."""
    beside = f"{path}-{uuid.uuid4().hex}"
    try:
        with open(beside, "wb") as out:
            return beside, *_joined(pieces, out)
    except BaseException:
        os.remove(beside)
        raise


class Parts:
    """What a file is joined from, in order: texts and the parts of DataFrames. The parts go when it is left."""

    def __init__(self, spark: SparkSession):
        self.spark, self.shared = spark, shared_path(spark)
        self.pieces: list[bytes | str] = []

    def __enter__(self) -> Parts:
        if self.shared:
            self.folder = f"{self.shared}/millrace-parts-{uuid.uuid4().hex}"
            os.makedirs(self.folder)
        else:
            self.folder = tempfile.mkdtemp()
        return self

    def __exit__(self, *_: Any) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def text(self, text: str) -> None:
        self.pieces.append(text.encode("utf-8"))

    def lines(self, df: DataFrame, between: str = "") -> int:
        """Adds the column ``value`` in arrival order; the number of rows."""
        df = df.orderBy(ORDER).select(F.make_valid_utf8("value").cast("binary").alias("value"))
        folder, between_ = self.folder, between.encode("utf-8")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lines = (line for batch in batches for line in batch.column(0).to_pylist())
            for place, path, rows in _part(folder, between_, TaskContext.get().partitionId(), lines):
                yield pa.RecordBatch.from_pydict({"place": [place], "path": [path], "rows": [rows]})

        if self.shared:
            return self._add(df.mapInArrow(run, "place long, path string, rows long").collect(), between_)
        return self._add(_part(folder, between_, 0, (bytes(r[0]) for r in df.toLocalIterator(prefetchPartitions=True))), between_)

    def records(self, df: DataFrame, line: Callable[[Any], bytes]) -> int:
        """Adds the rows, as ``line`` writes them, in the order of the partitions; their number."""
        folder = self.folder
        if self.shared:
            return self._add(df.rdd.mapPartitionsWithIndex(lambda place, rows: _part(folder, b"", place, map(line, rows))).collect(), b"")
        return self._add(_part(folder, b"", 0, map(line, df.toLocalIterator())), b"")

    def _add(self, found: Iterable, between: bytes) -> int:
        count = 0
        for _, path, rows in sorted(tuple(x) for x in found):
            self.pieces += [between, path] if between and count else [path]
            count += rows
        return count

    def join(self, out: Any) -> tuple[int, str]:
        """Writes the file that the driver has opened as ``out``; bytes, md5."""
        path = os.path.abspath(out.name)
        if not (self.shared and in_reach(self.spark, path)):
            return _joined(self.pieces, out)
        made = self.spark.sparkContext.parallelize([self.pieces], 1).map(lambda pieces: _joined_beside(pieces, path)).collect()[0]
        os.replace(made[0], path)
        return made[1:]

    def chunks(self) -> Iterator[bytes]:
        """The file's bytes on the driver, for what isn't a file."""
        return _chunks(self.pieces)
