"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A text's set holds its distinct shingles of ``words`` words. SuperMinHash gives each element a random permutation of the
signature's places; the j-th place of the permutation gets the value j plus a random fraction, and each place keeps its smallest
value. Places are filled in steps of j for all texts of a batch; a text stops as soon as no place can get smaller.

Texts of equal sets form a class, of which the smallest key takes part. Signatures are cut in bands; classes that agree in a
band share a bucket. Each member of a bucket is checked against the bucket's smallest key, on full sets, and verified links are
grouped by union-find. Members of a bucket that are then still apart are compared on full sets as well, in cells, which give one link
to each component that a member is linked with; so no bucket is expanded into its pairs, and no link among the members of a
bucket is lost. At the default similarity 0.8, 32 bands of 4 miss a link with a probability of 5e-8.

Defined results: null, empty and word-free texts have an empty set and no links; texts of fewer words have one shingle; rows with a null key
take no part and have a null component; rows of equal key are one node; ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, partitions, small_batches, stage, text_chunks, tidied, unstage, word_hashes
from .components import connected

PLACES, BAND_ROWS = 128, 4
WORDS = 5
#: A link: DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Members of a side of a cell, and columns of a matrix, that a task holds at a time.
_SIDE, _COLUMNS = 512, 4096
#: Parts of a class of equal sets, at least; there are as many as shuffle partitions.
_PARTS = 64
#: Elements that are permuted at once, and bytes of texts that are worked on at once.
_ELEMENTS, _CHUNK = 1 << 15, 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the text of each."""
    h, first = word_hashes(data, offsets)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    start = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(owner))
    size = np.minimum(n, words)[owner]
    out = size.astype(np.uint64)
    for k in range(words):
        inside = size > k
        with np.errstate(over="ignore"):
            out = np.where(inside, mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(start + k, len(h) - 1)]) if len(h) else out, out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], owner[keep]


def signatures(elements: np.ndarray, owner: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash values, (texts, places); infinite for empty sets."""
    values = np.full((texts, places), np.inf)
    for at in range(0, len(elements), _ELEMENTS):  # smallest values over parts are those over all
        _lower(values, elements[at : at + _ELEMENTS], owner[at : at + _ELEMENTS])
    return values


def _lower(values: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Takes elements into the signatures of their texts."""
    places = values.shape[1]
    permutation = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
    flat = values.ravel()
    texts = np.unique(owner)
    for j in range(places):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            draw = mix64(elements + np.uint64(j + 1) * np.uint64(0xD1342543DE82EF95))
        fraction = (draw & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32
        k = j + ((draw >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(elements))
        place = permutation[rows, k]
        permutation[rows, k] = permutation[:, j]
        np.minimum.at(flat, owner * places + place, j + fraction)
        # a later step gives j + 1 at least
        full = values[texts].max(axis=1) < j + 1
        if full.any():
            done = np.zeros(len(values), dtype=bool)
            done[texts[full]] = True
            left = ~done[owner]
            elements, owner, permutation, texts = elements[left], owner[left], permutation[left], texts[~full]


def _bands(values: np.ndarray, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(values).view(np.uint64)
    out = np.tile(np.arange(1, values.shape[1] // rows + 1, dtype=np.uint64), (len(values), 1))
    for k in range(rows):
        out = mix64(out ^ mix64(bits[:, k::rows]))
    return out.view(np.int64)


def sketch(docs: DataFrame, key: str, text: str, words: int, places: int = PLACES, rows: int = BAND_ROWS) -> DataFrame:
    """key, n_shingles, two fingerprints of the set, and band keys of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), _CHUNK):
                elements, owner = shingle_sets(data, offsets, words)
                n = b - a
                count = np.bincount(owner, minlength=n)
                some = count > 0
                starts = (np.cumsum(count) - count)[some]
                prints = np.zeros((2, n), dtype=np.uint64)
                if len(starts):
                    with np.errstate(over="ignore"):
                        prints[0, some] = np.add.reduceat(mix64(elements), starts)
                        prints[1, some] = np.bitwise_xor.reduceat(mix64(elements ^ np.uint64(0x5DEECE66D)), starts)
                values = signatures(elements, owner, n, places)
                bands = _bands(values, rows)
                width = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), pa.array(count.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(bands.ravel())),
                    ],
                    ["key", "n_shingles", "p1", "p2", "bands"],
                )

    small_batches(docs.sparkSession)
    rows_ = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows_.mapInArrow(tidied(run), "key long, n_shingles long, p1 long, p2 long, bands array<long>")


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Those pairs (x, y) of keys whose full sets are similar enough."""
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    joined = pairs.join(texts.select(F.col("key").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("key").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            for at, to in chunks(np.r_[0, np.cumsum(sizes)], 2 * _CHUNK):
                n = to - at
                part = batch.slice(at, n)
                both = pa.concat_arrays([part.column(2), part.column(3)])
                elements, owner, size = [], [], np.zeros(2 * n, dtype=np.int64)
                for a, b, data, offsets in text_chunks(both):
                    e, o = shingle_sets(data, offsets, words)
                    size[a:b] = np.bincount(o, minlength=b - a)
                    elements.append(e)
                    owner.append((o + a) % n)
                e, o = np.concatenate(elements), np.concatenate(owner)
                order = np.lexsort((e, o))
                e, o = e[order], o[order]
                shared = np.bincount(o[1:][(e[1:] == e[:-1]) & (o[1:] == o[:-1])], minlength=n)
                union = size[:n] + size[n:] - shared
                keep = pa.array((denominator * shared >= numerator * union) & (shared > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["x", "y"])

    return joined.mapInArrow(tidied(run), "x long, y long")


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int, m: int) -> np.ndarray:
    """Intersection sizes of n sets with m sets, each given as elements and owners, by products of incidence matrices."""
    common = np.intersect1d(left[0], right[0])
    out = np.zeros((n, m), dtype=np.float32)
    sides = []
    for elements, owner in (left, right):
        at = np.searchsorted(common, elements)
        there = at < len(common)
        there[there] = common[at[there]] == elements[there]
        at, owner = at[there], owner[there]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order]))
    for start in range(0, len(common), _COLUMNS):
        parts = []
        for (at, owner), rows in zip(sides, (n, m), strict=True):
            a, b = np.searchsorted(at, [start, start + _COLUMNS])
            x = np.zeros((rows, min(_COLUMNS, len(common) - start)), dtype=np.float32)
            x[owner[a:b], at[a:b] - start] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def _apart(rows: DataFrame, docs: DataFrame, key: str, text: str, words: int, numerator: int, denominator: int) -> DataFrame:
    """Links between members of a bucket that lie in different components: of each member one to each component that it is linked with.

    ``rows``: band, key, component. The members outside a bucket's largest component meet all members, on full sets, in cells of some
    hundred by some hundred; what a cell gives are links, never its pairs.
    """
    per = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most")).where("parts > 1")
    main = main.select("band", "main", F.ceil(F.col("all") / _SIDE).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("most")) / _SIDE).cast("int").alias("high"))
    mine = lambda n: F.array(F.pmod(F.xxhash64("key"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    here = rows.join(main, "band")
    sides = here.select("band", "key", "component", F.lit(False).alias("asks"), mine("wide").alias("i"), every("high").alias("j")).unionByName(
        here.where(F.col("component") != F.col("main")).select("band", "key", "component", F.lit(True).alias("asks"), every("wide").alias("i"), mine("high").alias("j"))
    )
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    gathered = sides.groupBy("key").agg(F.collect_list(F.struct("band", "component", "asks", "i", "j")).alias("places"))  # two for each band at most
    cells = texts.join(gathered, "key").select("key", "text", F.explode("places").alias("p")).select("key", "text", "p.*").withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        sides = []
        for part in (table.filter(pa.array(asks)), table.filter(pa.array(~asks))):
            elements, owner = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for a, _, data, offsets in text_chunks(part.column("text")) if part.num_rows else ():
                e, o = shingle_sets(data, offsets, words)
                elements.append(e)
                owner.append(o + a)
            sides.append((np.concatenate(elements), np.concatenate(owner), part.column("key").to_numpy(), part.column("component").to_numpy()))
        (e1, o1, k1, c1), (e2, o2, k2, c2) = sides
        shared = overlaps((e1, o1), (e2, o2), len(k1), len(k2))
        union = np.bincount(o1, minlength=len(k1))[:, None] + np.bincount(o2, minlength=len(k2))[None, :] - shared
        linked = (denominator * shared >= numerator * union) & (shared > 0) & (c1[:, None] != c2[None, :])
        x, y = [], []
        for s in np.flatnonzero(linked.any(axis=1)):
            to = np.flatnonzero(linked[s])
            _, one = np.unique(c2[to], return_index=True)
            x.extend(np.minimum(k1[s], k2[to[one]]))
            y.extend(np.maximum(k1[s], k2[to[one]]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return cells.groupBy("band", "i", "j").applyInArrow(tidied(compare), "x long, y long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, places: int = PLACES, rows: int = BAND_ROWS
) -> DataFrame:
    """A row for each row of ``docs``: key, n_shingles, component (smallest key that links lead to)."""
    sketches = stage(sketch(docs, key, text, words, places, rows), "sketches")
    taking = sketches.where("key is not null and n_shingles > 0")
    same = ["p1", "p2", "n_shingles"]
    # copies meet in parts of their class first, so a class of any size is spread over tasks
    parted = taking.select("key", *same, F.pmod(F.xxhash64("key"), F.lit(max(_PARTS, partitions(docs.sparkSession)))).alias("part"))
    parts = parted.groupBy(*same, "part").agg(F.min("key").alias("near"))
    classes = parts.groupBy(*same).agg(F.min("near").alias("rep"))
    copies = parted.join(parts, [*same, "part"]).where("key <> near").select(F.col("near").alias("x"), F.col("key").alias("y"))
    heads = parts.join(classes, same).where("near <> rep").select(F.col("rep").alias("x"), F.col("near").alias("y"))
    nodes = taking.join(classes.select(F.col("rep").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key", *same])
    banded = nodes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(banded.join(buckets, "band").select("band", "key", "least"), "buckets")
    pairs = shared.where("key <> least").select(F.col("least").alias("x"), F.col("key").alias("y")).distinct()
    links = stage(verify(pairs, docs, key, text, words, numerator, denominator), "verified")
    grouped = connected(links, "x", "y")
    found = stage(grouped, "components")
    unstage(grouped)
    # what is still apart within a bucket; the pairs with the bucket's smallest key have been checked
    rest = shared.where("key <> least").join(found.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("component"))
    more = stage(_apart(rest, docs, key, text, words, numerator, denominator), "verified")
    unstage(shared, found)
    grouped = connected(links.union(more).union(copies).union(heads), "x", "y")
    found = stage(grouped, "components")
    unstage(grouped, links, more)
    return sketches.select("key", "n_shingles").join(found.withColumnRenamed("node", "key"), "key", "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("root", "key").alias("component"))
