"""Quality scores of documents: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text gives a fixed vector of statistics (shares of letters, capitals, digits and symbols, word and line lengths,
repetition of words, pairs and lines ...). Cosines of random projections of the standardised statistics approximate a
Gaussian kernel. The normal equations are summed in each partition, then by row of the matrix over some partitions, then over
all; they are solved on the driver (their size is fixed), and the raw scores are calibrated by pool-adjacent-violators on sums over
fixed score bins. Texts are read once, to describe them; all else works on their statistics.

Defined results: null and empty texts have all-zero statistics and a score like any other; rows without a label are not
learned; labels of a document that occurs more than once count each time; without any label all scores are 0.5. Documents of equal
statistics get equal scores, and raw scores in one bin of the calibration count as ties: they are calibrated together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slice_hashes, small_batches, stage, text_chunks, tidied, unstage, word_bounds

_CLASS = np.zeros((256, 8), dtype=bool)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = [
        _c >= 128 or _s.isalpha(),
        65 <= _c <= 90,
        48 <= _c <= 57,
        _c in b".,;:'\"()-",
        _c in b"!?",
        33 <= _c <= 126 and not _s.isalnum() and _c not in b".,;:'\"()-!?",
        _c == 10,
        _c in b"|<>{}[]\\=",
    ]
STATISTICS = (
    "letters capitals digits stops shouts symbols lines bars log_bytes log_words word_mean word_spread repeats distinct common pairs distinct_lines line_words capital_words short_words".split()
)
FEATURES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
BINS = 4096
#: Partitions whose sums are added in one task, before all are.
_PARTS = 256
_LOW, _HIGH = -1.0, 2.0


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct keys and how often the most common one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])])
    runs = np.diff(np.r_[new, len(k)])
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    return np.bincount(o[new], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    some = size > 0
    for k in range(8):
        out[some, k] = np.add.reduceat(_CLASS[:, k][data].view(np.uint8), offsets[:-1][some], dtype=np.int64) / size[some]
    starts, ends, first = word_bounds(data, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    words, length = np.maximum(count, 1), (ends - starts).astype(float)
    hashes = slice_hashes(data, starts, ends)
    mean = np.bincount(owner, length, n) / words
    out[:, 8], out[:, 9], out[:, 10] = np.log1p(size), np.log1p(count), mean
    out[:, 11] = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / words - mean**2, 0))
    same = owner[1:] == owner[:-1]
    out[:, 12] = np.bincount(owner[1:][same & (hashes[1:] == hashes[:-1])], minlength=n) / words
    distinct, most = _distinct(owner, hashes, n)
    out[:, 13], out[:, 14] = distinct / words, most / words
    pairs, _ = _distinct(owner[1:][same], mix64(hashes[1:][same] ^ mix64(hashes[:-1][same])), n)
    out[:, 15] = pairs / words
    breaks = np.flatnonzero(data == 10)
    at = np.unique(np.r_[offsets[:-1][size > 0], breaks + 1])
    at = at[at < len(data)]
    line_end = np.r_[at[1:], len(data)]
    line_owner = np.searchsorted(offsets, at, side="right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    distinct, _ = _distinct(line_owner, slice_hashes(data, at, line_end), n)
    out[:, 16], out[:, 17] = distinct / lines, np.log1p(count / lines)
    out[:, 18] = np.bincount(owner[_CLASS[data[starts], 1]], minlength=n) / words
    out[:, 19] = np.bincount(owner[length <= 2], minlength=n) / words
    return out


def describe(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and the statistics of its text, as an array of doubles named ``stats``."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                s = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["key", "stats"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"key {kind}, stats array<double>")


class QualityModel:
    """Standardisation, random features, ridge weights and the calibration curve; all of fixed size."""

    def __init__(self, features: int = FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = 20240):
        rng = np.random.default_rng(seed)
        d = len(STATISTICS)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.w, self.b = rng.normal(0, 1 / bandwidth, (d, features)), rng.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.ridge, self.x, self.y = ridge, np.array([0.0]), np.array([0.5])

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.c_[np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.weights is None else self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def pool_adjacent_violators(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of weighted points in order of x: the middle x and the mean of each block."""
    blocks: list[list[float]] = []
    for xi, t, w in zip(x, total, weight, strict=True):
        blocks.append([xi * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch.column(column)), len(STATISTICS))


def fit(labelled: DataFrame, model: QualityModel | None = None) -> QualityModel:
    """Learn from rows (stats, label 0 or 1). All sums cover all rows."""
    model = model or QualityModel()
    rows = stage(labelled.select("stats", F.col("label").cast("double").alias("label")).where("stats is not null and label is not null"), "labelled")  # read three times
    d = len(STATISTICS)
    sums = rows.select(F.count(F.lit(1)), *[f(F.col("stats")[k]) for k in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        unstage(rows)
        return model
    model.mean = np.array([sums[1 + 2 * k] for k in range(d)])
    model.scale = np.maximum([sums[2 + 2 * k] for k in range(d)], 1e-6)
    size = model.w.shape[1] + 1
    sc = labelled.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                z = shared.value.expand(_matrix(part, 0))
                total += z.T @ np.c_[z, part.column(1).to_numpy(zero_copy_only=False)]
        if total[-1, -2]:
            near = TaskContext.get().partitionId() // _PARTS
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, near, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "near", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, dtype=float) for x in table.column("part").to_pylist()], axis=0)
        return pa.table({"i": table.column("i")[:1], "near": table.column("near")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    kinds = "i int, near int, part binary"
    parts = rows.mapInArrow(tidied(equations), kinds).groupBy("i", "near").applyInArrow(tidied(add), kinds).groupBy("i").applyInArrow(tidied(add), kinds).collect()  # a row of the matrix each
    total = np.array([np.frombuffer(r["part"], dtype=float) for r in sorted(parts, key=lambda r: r["i"])])
    n = total[-1, -2]
    model.weights = np.linalg.solve(total[:, :-1] + model.ridge * n * np.eye(size) / size, total[:, -1])
    fitted = sc.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((fitted.value.raw(_matrix(batch, 0)) - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "label"])

    curve = rows.mapInArrow(tidied(bins), "bin int, label double").groupBy("bin").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    unstage(rows)
    x = np.array([_LOW + (r["bin"] + 0.5) * (_HIGH - _LOW) / BINS for r in curve])
    model.x, model.y = pool_adjacent_violators(x, np.array([r["y"] for r in curve]), np.array([float(r["n"]) for r in curve]))
    return model


def score(described: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """Rows of ``describe`` with their scores."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_matrix(batch, 1)))], ["key", name])

    kind = described.schema["key"].dataType.simpleString()
    return described.select("key", "stats").mapInArrow(tidied(run), f"key {kind}, {name} double")
