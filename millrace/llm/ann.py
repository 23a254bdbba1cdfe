"""Approximate nearest neighbours by a permutation index.

Pivots are taken farthest first from a bounded sample, so that they are apart by a real angle and near copies yield one. Their number
grows with the root of the number of vectors, up to ``MOST_PIVOTS``, so the work of all queries grows with the power 1.5 of it. A
vector is represented by its nearest pivots in order. It is posted, with that order, in the inverted files of its first
``postings`` pivots; a query looks into the files of its own first ``probes`` pivots, ranks what it finds by footrule distance
between the orders, and reranks the nearer share (``depth``) of each file by cosine in double precision. A share follows a file's
length, so groups of near copies, whose orders are alike, keep their part of it. Files longer than ``block`` are split by a hash of the
key, so that a hot pivot or many copies of a vector spread over tasks; a query visits all parts. Without a ``depth`` whole files are
reranked; if also all pivots are probed, the search is exact.

Defined results: vectors that are null, zero, empty, of another length than most, or hold a null or non-finite component take no part; ties
go to the smaller key; a query never returns the row of its own key; fewer candidates than k give fewer rows. A null key takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, small_batches, tidied

#: Pivots: so many times the root of the number of vectors, within bounds.
PIVOT_RATE, LEAST_PIVOTS, MOST_PIVOTS = 4, 64, 2048
#: The pivots are chosen among so many rows at most (by a hash of the key); everything else covers all rows.
PIVOT_SAMPLE = 8192
ORDER = 128
POSTINGS = 8
PROBES = 48
#: The share of a file that is nearest by footrule and so is reranked, and how many at least.
DEPTH, LEAST_DEPTH = 0.25, 32
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part (but for its length)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` distinct directions: the first one, then always the one that is farthest from those taken."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    taken = [0]
    nearest = unit @ unit[0]
    while len(taken) < count and nearest.min() < 1 - 1e-12:
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[taken]


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties to the smaller pivot."""
    away = -(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ pivots.T)
    kind = np.uint8 if len(pivots) <= 256 else np.uint16
    if length >= len(pivots):
        return np.argsort(away, axis=1, kind="stable").astype(kind)
    near = np.sort(np.argpartition(away, length - 1, axis=1)[:, :length], axis=1)  # by pivot, for ties
    return np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, axis=1), axis=1, kind="stable"), axis=1).astype(kind)


def footrule(query: np.ndarray, posted: np.ndarray, pivots: int) -> np.ndarray:
    """Spearman's footrule between an order and each of many; a pivot missing from an order counts as just behind its end."""
    length = len(query)
    rank = np.full(pivots, length, dtype=np.int16)
    rank[query] = np.arange(length, dtype=np.int16)
    there = rank.take(posted)
    # |rank here - rank there| over the posted order; pivots only in the query's order add length - rank each, which is the
    # constant of all its pivots less that of the shared ones; |x - y| + x is twice the larger one less y
    width = posted.shape[1]
    np.maximum(there, np.arange(width, dtype=np.int16), out=there)
    return 2 * there.sum(axis=1, dtype=np.int32) + (length * (length + 1) // 2 - length * width - width * (width - 1) // 2)


def nearer(steps: np.ndarray, count: int) -> np.ndarray:
    """Which are the ``count`` smallest; ties to the earlier one."""
    if len(steps) <= count:
        return np.ones(len(steps), dtype=bool)
    bound = np.partition(steps, count - 1)[count - 1]
    out = steps < bound
    out[np.flatnonzero(steps == bound)[: count - out.sum()]] = True
    return out


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def search(
    df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    pivots: int | None = None, order: int = ORDER, postings: int = POSTINGS, probes: int = PROBES, depth: float | None = DEPTH, block: int = BLOCK,
) -> DataFrame:
    """The k nearest rows of each row that ``queries`` is true for: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    small_batches(spark)
    kept = np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("key").isNotNull() & usable(F.col("v")))
    empty = "query_id long, rank int, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(PIVOT_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], empty)
    sizes = pc.list_value_length(sample).to_numpy()
    dims = int(np.bincount(sizes).argmax())
    rows = rows.where(F.size("v") == dims)
    if pivots is None:
        pivots = int(min(max(LEAST_PIVOTS, PIVOT_RATE * rows.count() ** 0.5), MOST_PIVOTS))
    chosen = spark.sparkContext.broadcast(choose_pivots(_matrix(sample.filter(pa.array(sizes == dims)), dims), pivots))
    postings, probes = min(postings, pivots), min(probes, pivots)
    order = max(order if depth is not None else 0, postings, probes)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                v, p = _matrix(part.column(1), dims), chosen.value
                o = orders(v, p, order)
                asks = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                for query, who, width in ((False, np.arange(len(v)), postings), (True, np.flatnonzero(asks), probes)):
                    if len(who):
                        files = o[who, :width]
                        times = files.shape[1]
                        at = np.repeat(who, times)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(files.ravel().astype(np.int32)), pa.array(np.full(len(at), query)), pa.array(keys[at]),
                                pa.array([x.tobytes() if depth is not None else b"" for x in o[at]], pa.binary()), pa.array([x.tobytes() for x in v[at].astype(kept)], pa.binary()),
                            ],
                            ["pivot", "asks", "key", "perm", "v"],
                        )

    posted = rows.mapInArrow(tidied(post), "pivot int, asks boolean, key long, perm binary, v binary")
    lengths = {r["pivot"]: r["n"] for r in posted.where("not asks").groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pivot
    parts = F.array(*[F.lit(max(1, -(-lengths.get(p, 0) // block))) for p in range(pivots)])
    posted = posted.withColumn("parts", F.element_at(parts, F.col("pivot") + 1))
    where = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    spread = posted.withColumn("part", F.explode(where)).drop("parts")

    def look(table: pa.Table) -> pa.Table:
        p = len(chosen.value)
        asks = table.column("asks").to_numpy()
        keys, v = table.column("key").to_numpy(), np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=kept).reshape(-1, dims).astype(float)
        kind = np.uint8 if p <= 256 else np.uint16
        perms = np.frombuffer(b"".join(table.column("perm").to_pylist()), dtype=kind).reshape(len(keys), -1) if depth is not None else np.zeros((len(keys), 0), dtype=kind)
        here, there = np.flatnonzero(~asks), np.flatnonzero(asks)
        here = here[np.argsort(keys[here], kind="stable")]
        out: tuple[list, list, list] = ([], [], [])
        norm = np.sqrt((v * v).sum(axis=1))
        posted, own = perms[here].astype(np.intp), keys[here]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])  # of the rows of a key
        ids, times = own[starts], np.diff(np.r_[starts, len(own)])
        for q in there if len(here) else ():
            taken = ids != keys[q]
            if depth is not None:
                steps = np.minimum.reduceat(footrule(perms[q], posted, p), starts)
                taken[taken] = nearer(steps[taken], max(k, LEAST_DEPTH, math.ceil(depth * len(ids))))
            best = here[np.repeat(taken, times)]
            cosine = (v[best] * v[q]).sum(axis=1) / (norm[best] * norm[q])  # not by a product of matrices, whose last digits depend on the place
            top = np.lexsort((keys[best], -cosine))
            _, first = np.unique(keys[best[top]], return_index=True)
            top = top[np.sort(first)[:k]]
            out[0].extend([keys[q]] * len(top))
            out[1].extend(keys[best[top]])
            out[2].extend(cosine[top])
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    tasks = max(partitions(spark), sum(lengths.values()) // (2 * block) + 1)
    found = spread.repartition(tasks, "pivot", "part").groupBy("pivot", "part").applyInArrow(tidied(look), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
