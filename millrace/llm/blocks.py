"""Documents in blocks that exchange facts about 64-bit keys.

Documents are dealt to blocks of some megabytes, by ranges of their key or by hash. A block's task sends each of its distinct keys once,
with its count, to the bucket that the key's first bits name; a bucket's task adds up and answers each block, in the order of
its keys, with the totals and with whether that block is the first that has the key. Keys may have a second hash beside (``checks``), so that
only keys of equal 96 bits count as one. Hot keys and groups of copies thus cost
a row for each block at most, buckets are even as keys are hashes, and answers hold no keys: the block makes them
again. The whole is one plan: blocks -> buckets -> blocks, in which the documents' exchange is used again. A block sends a row to each
bucket and gets one from each, whatever the kinds of keys in it; so rows grow with the square of the blocks, as the pieces of any
exchange of so many tasks with so many do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, small_batches, tidied

#: Bytes of text in a block. A text isn't divided, so a longer one is in a larger block.
BLOCK_BYTES = 8 << 20
#: Beyond so many blocks, blocks grow instead (at 100 TB to 100 MB).
MOST_BLOCKS = 1 << 20
BLOCK, TIE = "_block", "_tie"
MESSAGE = "bucket int, block int, kind array<int>, n array<long>, keys array<binary>, checks array<binary>, counts array<binary>"
ANSWER = f"{BLOCK} int, bucket int, kind array<int>, n array<long>, counts array<binary>, first array<binary>, distinct array<long>, total array<long>"
#: A message of one kind: kind, n, keys, checks, counts.
Part = tuple[int, int, bytes, bytes, bytes]


def pack(a: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b""


def unpack(b: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=n * size), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as unsigned numbers of the fewest bytes that hold them all (the first byte says how many), up to 64 bits."""
    kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + pack(counts.astype(kind))


def unpack_counts(b: bytes, n: int) -> np.ndarray:
    return unpack(b[1:], n, np.dtype(f"u{b[0]}")).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n, np.uint64), dtype=np.uint64)


def _size(docs: DataFrame, key: str, text: str, block_bytes: int) -> tuple[int, int, int]:
    """How many blocks the texts need, and how many rows there are in all and with a null key."""
    small_batches(docs.sparkSession)
    size, rows, nulls = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")), F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    size = size or 0
    least = min(partitions(docs.sparkSession), size // (1 << 20) + 1)
    return max(1, least, -(-size // max(block_bytes, size // MOST_BLOCKS))), rows, nulls


def spread(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with the number of their block, by a hash of key and text, and how many blocks there are. No key can fill a block."""
    n, _, _ = _size(docs, key, text, block_bytes)
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n)).cast("int")), n


def deal(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with the number of their block and a tie-breaker, and how many blocks there are.

    Blocks are ranges of (key, tie-breaker); null keys come first. The tie-breaker is a hash of the text, so that rows of a null or
    repeated key fill as many blocks as they need. The cut points (8 bytes a block, of MOST_BLOCKS at most) go to the tasks.
    """
    n, rows, nulls = _size(docs, key, text, block_bytes)
    for_nulls = -(-n * nulls // rows) if nulls else 0
    docs = docs.withColumn(TIE, F.xxhash64(F.col(text)))
    if n == 1:
        return docs.withColumn(BLOCK, F.lit(0)), 1
    found = docs.agg(F.percentile_approx(F.col(key), [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    cuts = np.array(found or [], dtype=np.int64)  # a key stands here as often as it fills blocks

    @F.pandas_udf("int")
    def block(keys: pd.Series, ties: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        place = ((ties.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64)  # 32 bits, in the order of ties
        out = place * for_nulls >> 32
        k = keys[known].astype(np.int64).to_numpy()
        low = np.searchsorted(cuts, k, side="left")
        out[known] = for_nulls + low + (place[known] * (np.searchsorted(cuts, k, side="right") - low) >> 32)
        return pd.Series(out.astype(np.int32))

    return docs.withColumn(BLOCK, block(F.col(key).cast("long"), F.col(TIE))), for_nulls + len(cuts) + 1


def distinct(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys (of equal ones as they stand), and which in that order are the first of their kind."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    ordered = keys[order]
    new[1:] = ordered[1:] != ordered[:-1]
    if checks is not None:
        ordered = checks[order]
        other = np.flatnonzero(~new[1:] & (ordered[1:] != ordered[:-1]))
        if len(other):  # hardly ever
            order = np.lexsort((checks, keys))
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    return order, new


def edges(buckets: int) -> np.ndarray:
    """Where the buckets after the first one begin."""
    return np.array([i * ((1 << 64) // buckets + 1) for i in range(1, buckets)], dtype=np.uint64)


def messages(kind: int, keys: np.ndarray, counts: np.ndarray | None, buckets: int, checks: np.ndarray | None = None) -> list[Part]:
    """A part for each bucket; ``keys`` are sorted and distinct. All buckets get one, so that each answers each block."""
    at = np.r_[0, np.searchsorted(keys, edges(buckets)), len(keys)]
    return [(kind, int(b - a), pack_keys(keys[a:b]), b"" if checks is None else pack(checks[a:b]), b"" if counts is None else pack_counts(counts[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]


def posted(block: int, *kinds: list[Part]) -> list[tuple]:
    """The block's messages: a row for each bucket, with the parts of all kinds."""
    return [(bucket, block, *map(list, zip(*parts, strict=True))) for bucket, parts in enumerate(zip(*kinds, strict=True))]


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def add_up(table: pa.Table, firsts: bool = True) -> pa.Table:
    """The answers of a bucket; without ``firsts``, no block learns whether it is the first. Parts of kind below 0 pass through to their block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    out: list[list[tuple]] = [[] for _ in rows]
    for kind in sorted({k for r in rows for k in r["kind"]}):
        part = [(i, j) for i, r in enumerate(rows) for j, k in enumerate(r["kind"]) if k == kind]
        of = lambda name: [rows[i][name][j] for i, j in part]  # noqa: E731, B023
        if kind < 0:
            for (i, _), n, counts in zip(part, of("n"), of("counts"), strict=True):
                out[i].append((kind, n, counts, b"", 0, 0))
            continue
        sizes = of("n")
        keys = np.concatenate([unpack_keys(x, n) for x, n in zip(of("keys"), sizes, strict=True)])
        checks = np.concatenate([unpack(x, n, np.uint32) for x, n in zip(of("checks"), sizes, strict=True)]) if any(of("checks")) else None
        order, new = distinct(keys, checks)  # blocks stay in order within a key
        del keys, checks
        starts = np.flatnonzero(new)
        first = np.zeros(len(order), dtype=bool)
        first[order[starts]] = True
        totals, different, total = np.zeros(len(order), dtype=np.uint8), 0, 0
        if (counted := any(of("counts"))) and len(order):
            counts = np.concatenate([unpack_counts(x, n) for x, n in zip(of("counts"), sizes, strict=True)])
            sums = np.add.reduceat(counts[order], starts)
            different, total = int((sums > 0).sum()), int(sums.sum())
            totals = np.zeros(len(order), dtype=np.min_scalar_type(int(sums.max())))
            totals[order] = np.repeat(sums.astype(totals.dtype), np.diff(np.r_[starts, len(order)]))
        at = 0
        for (i, _), n in zip(part, sizes, strict=True):
            out[i].append((kind, n, pack_counts(totals[at : at + n]) if counted else b"", np.packbits(first[at : at + n]).tobytes() if firsts else b"", different, total))
            at += n
    return table_of([(r["block"], r["bucket"], *map(list, zip(*parts, strict=True))) for r, parts in zip(rows, out, strict=True)], ANSWER)


class Answers:
    """The answers to a block, joined over all buckets in order."""

    def __init__(self, table: pa.Table):
        names = ["kind", "n", "counts", "first", "distinct", "total"]
        self.rows = [dict(zip(names, part, strict=True)) for r in sorted(table.to_pylist(), key=lambda r: r["bucket"]) for part in zip(*(r[x] for x in names), strict=True)]

    def _of(self, kind: int) -> list[dict]:
        return [r for r in self.rows if r["kind"] == kind]

    def totals(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int64), *(unpack_counts(r["counts"], r["n"]) for r in self._of(kind))])

    def first(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=bool), *(np.unpackbits(np.frombuffer(r["first"], dtype=np.uint8), count=r["n"]).astype(bool) for r in self._of(kind))])

    def sums(self, kind: int) -> tuple[int, int]:
        """How many distinct keys of positive count there are in all blocks, and their counts' sum."""
        return sum(r["distinct"] for r in self._of(kind)), sum(r["total"] for r in self._of(kind))

    def passed(self, kind: int) -> bytes:
        return next((r["counts"] for r in self._of(kind)), b"")


def ask(dealt: DataFrame, send: Callable[[int, pa.Table], list[tuple]], answers: DataFrame | None = None, heard: Callable[[int, pa.Table, Answers], list[tuple]] | None = None, firsts: bool = True) -> DataFrame:
    """A round: blocks send messages (``send``, or ``heard`` if they had answers before), buckets answer."""

    def sent(table: pa.Table) -> pa.Table:
        return table_of(send(table.column(BLOCK)[0].as_py(), table), MESSAGE)

    def sent_again(table: pa.Table, given: pa.Table) -> pa.Table:
        rows = heard(table.column(BLOCK)[0].as_py(), table, Answers(given)) if table.num_rows else []
        return table_of(rows, MESSAGE)

    out = dealt.groupBy(BLOCK).applyInArrow(tidied(sent), MESSAGE) if answers is None else dealt.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(tidied(sent_again), MESSAGE)
    def answered(table: pa.Table) -> pa.Table:
        return add_up(table, firsts)

    return out.groupBy("bucket").applyInArrow(tidied(answered), ANSWER)


def conclude(dealt: DataFrame, answers: DataFrame, finish: Callable[[int, pa.Table, Answers], pa.Table], schema: T.StructType) -> DataFrame:
    """The last step: blocks with their answers give rows."""

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        return finish(table.column(BLOCK)[0].as_py() if table.num_rows else -1, table, Answers(given))

    return dealt.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(tidied(run), schema)
