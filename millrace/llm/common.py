"""Shared pieces: Arrow text access, vectorised hashing of words and bytes, tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
#: Texts are worked on in chunks of about so many bytes, to bound a task's memory; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to some megabytes, as texts can be long; records alone don't bound them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _allocator(name: str, *values: int) -> None:
    """Calls a function of the C library's allocator, where it has it."""
    try:
        getattr(ctypes.CDLL(None), name)(*values)
    except (AttributeError, OSError):  # another C library
        pass


#: Arrays up to 16 MB come from the heap, which isn't cut before a task's end; larger ones get maps of their own. Else the system would clear
#: pages for every array anew. -3 and -1 are the C library's fixed names of the two thresholds.
_allocator("mallopt", -3, 16 << 20)
_allocator("mallopt", -1, 512 << 20)


def tidy() -> None:
    """Gives memory that is free back to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _allocator("malloc_trim", 0)


def tidied(f: Callable) -> Callable:
    """A function of batches, a table, or two tables, that tidies up when it is done."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                forget_powers()
                tidy()

    elif f.__code__.co_argcount == 1:

        def run(table):
            try:
                return f(table)
            finally:
                tidy()

    else:

        def run(left, right):
            try:
                return f(left, right)
            finally:
                tidy()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(U64)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_STEP = U64(0x9E3779B97F4A7C15)
#: The steps of two independent hashes, their inverses, and random values of bytes.
_STEPS = (_STEP, U64(0xD6E8FEB86659FD93))
_INVERSES = tuple(U64(pow(int(x), -1, 1 << 64)) for x in _STEPS)
with np.errstate(over="ignore"):
    _BYTES = tuple(mix64(np.arange(1 + 256 * k, 257 + 256 * k, dtype=U64) * x) for k, x in enumerate(_STEPS))
_powers: dict[int, np.ndarray] = {}
_QUARTER = (CHUNK_BYTES >> 2) + 4096


def _power(step: np.uint64, n: int) -> np.ndarray:
    which = int(step)
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1 if n > _QUARTER else _QUARTER)  # some operators take a chunk at once, some a quarter of it
        a = np.full(size, step, dtype=U64)
        a[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(a, dtype=U64)
        if size <= 4 * CHUNK_BYTES:
            _powers[which] = have
    return have[:n]


def forget_powers() -> None:
    """Frees the tables of powers, up to 67 MB, which a worker would else keep as long as it lives."""
    _powers.clear()


class ByteHash:
    """Hashes of any slices of a byte array in constant time each (a polynomial over 2**64 with random byte values).

    ``which``: one of two independent hashes; both together make 128 bits.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[which][data] * _power(_STEPS[which], len(data)), out=self.prefix[1:])
        self.down = _power(_INVERSES[which], len(data) + 1)

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all slices of ``width`` bytes."""
        with np.errstate(over="ignore"):
            n = len(self.prefix) - width
            return mix64((self.prefix[width:] - self.prefix[:n]) * self.down[:n] + np.uint64(width) * _STEP)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.prefix[end] - self.prefix[start]) * self.down[start]
            return mix64(h + (end - start).astype(U64) * _STEP)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null as empty) and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about ``limit`` bytes."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each text's first word (with one more entry at the end)."""
    n = len(data)
    word = ~_BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased A-Z, and each text's first word."""
    starts, ends, first = word_bounds(data, offsets)
    return slice_hashes(data, starts, ends), first


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending slices that don't overlap, lower-cased A-Z; some megabytes at a time, however long a text is."""
    if len(data) <= 2 * CHUNK_BYTES:
        return ByteHash(lower_ascii(data))(starts, ends)
    out, i = np.empty(len(starts), dtype=U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        lo = starts[i]
        out[i:j] = ByteHash(lower_ascii(data[lo : ends[j - 1]]))(starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last value, bytes and offsets of each chunk of a string column."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a string column that hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return chunks(np.r_[0, np.cumsum(sizes, dtype=np.int64)], limit)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "millrace-checkpoints")


#: Staged tables of this process that are still there.
_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _staged.append(path)
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them is staged itself, or was collected."""
    for df in tables:
        _delete(df.sparkSession, getattr(df, "staged_at", None))


def staged_whole(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stages what ``make`` plans, and deletes all tables that it staged on the way."""
    mark = len(_staged)
    out = stage(make(), name)
    for path in _staged[mark:]:
        if path != out.staged_at:
            _delete(out.sparkSession, path)
    return out


def _delete(spark: SparkSession, path: str | None) -> None:
    if path in _staged:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _staged.remove(path)


def free(name: str, taken: list[str]) -> str:
    """The name, with marks before it until none of ``taken`` is equal (Spark's names don't heed case)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def widened(schema: T.StructType, *fields: tuple[str, str | T.DataType]) -> T.StructType:
    """A new schema with more fields."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out
