"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts of each language over all training texts (partial sums in each partition, then by
language and bucket) and writes them to the shared folder. The log-probability matrix has a fixed number of rows (``buckets``) and a
column for each language; it is broadcast in slices of ``SLICE`` languages, so a task holds a bounded part of it. Texts of more
languages than one slice are scored slice by slice, and the slices' best totals and sums are combined exactly.

Defined results: a null text or one without a letter is ``und`` with score 0; a null language is never learned;
with nothing to learn from, every text is ``und``. Of languages of equal probability the smaller name is taken. Rows are scored one by
one, so repeated rows get equal results. A long text is read in slices that carry the characters before them, so memory is bounded.

The posterior says which language is the best of those learned; it nears 1 with length on texts in none of them, too. Likeness says
whether a text is in that language at all: its mean log-probability an n-gram, from 0 where n-grams fall at random to 1 where
the language's training texts are on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, stage, text_slices, tidied, unstage

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Languages of one broadcast matrix: 34 MB.
SLICE = 128
#: Bytes of texts that are worked on at once, and characters of a long text.
_CHUNK, _LONG = 1 << 19, 1 << 18
#: Entries of the matrix that are gathered at once.
_GATHER = 1 << 22
_FOUND = "__langid"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and the text that each belongs to; and which texts hold a letter.

    Texts are lower-cased; each run of other characters than letters counts as one blank; n-grams don't cross texts.
    """
    is_letter = letters()
    lowered = [" " + t.lower() + " " for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter[np.minimum(points, 0x10FFFF)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as the blank
    first = np.cumsum(sizes) - sizes
    keep[first] = True
    points, owner = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64), owner[keep]
    return [_keys(points, owner, n, buckets) for n in orders], has


def _keys(points: np.ndarray, owner: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    if len(points) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    m = len(points) - n + 1
    key = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        key = (key << np.uint64(21)) | points[i : i + m] if i < 3 else mix64(key) ^ points[i : i + m]
    ok = owner[:m] == owner[n - 1 :]
    return (mix64(key[ok]) & np.uint64(buckets - 1)).astype(np.int64), owner[:m][ok]


def long_ngrams(text: str, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """As ``ngrams`` of the one text, in parts; each part carries the last characters of the one before."""
    is_letter, back = letters(), max(orders) - 1
    before = np.full(1, 32, dtype=np.uint64)
    at, first = 0, True
    while at <= len(text):
        end = min(at + _LONG, len(text))
        while at < end < len(text) and end > at + _LONG // 2 and text[end - 1].isalpha():  # between words, so that lower-casing sees whole words
            end -= 1
        last = end == len(text)
        part = np.frombuffer((text[at:end].lower() + " " * last).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = is_letter[np.minimum(part, 0x10FFFF)]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(part):
            keep[0] |= before[-1] != 32
        new = np.where(letter, part, np.uint32(32))[keep].astype(np.uint64)
        seq = np.r_[before, new]
        out = []
        for n in orders:
            have = seq if first else seq[max(len(before) - n + 1, 0) :]
            out.append(_keys(have, np.zeros(len(have), dtype=np.int32), n, buckets))
        yield out, np.array([bool(letter.any())])
        before, first = seq[max(len(seq) - max(back, 1), 0) :], False
        if last:
            return
        at = end


def _counted(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Ranges of texts with their n-grams; a long text is a range of its own that comes in several parts."""
    start = 0
    for i, t in enumerate([*texts, None]):
        if t is None or len(t) > 2 * _LONG:
            if i > start:
                yield start, i, *ngrams(texts[start:i], orders, buckets)
            if t is not None:
                for grams, has in long_ngrams(t, orders, buckets):
                    yield i, i + 1, grams, has
            start = i + 1


class LanguageModel:
    """Languages, log-prior and log-probability matrix of shape (buckets, languages), for all languages or a slice of them."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, orders: tuple[int, ...], smoothing: float, everywhere: tuple[float, int] | None = None):
        self.languages, self.orders, self.buckets = languages, orders, counts.shape[0]
        total, many = everywhere or (documents.sum(), len(languages))
        self.prior = np.log(documents + 1.0) - np.log(total + many) if languages else np.zeros(0)
        self.logp = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * self.buckets)
        self.typical = (counts * self.logp).sum(axis=0) / np.maximum(counts.sum(axis=0), 1)
        self.random = self.logp.mean(axis=0)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log-probability with each language, its n-grams, and whether it holds a letter."""
        total = np.repeat(self.prior[None, :], len(texts), axis=0)
        n, has = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        step = max(1, _GATHER // max(1, len(self.languages)))
        for a, b, grams, letter in _counted(texts, self.orders, self.buckets):
            has[a:b] |= letter
            for bucket, owner in grams:
                for at in range(0, len(owner), step):
                    o = owner[at : at + step]
                    starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    total[a + o[starts]] += np.add.reduceat(self.logp[bucket[at : at + step]], starts, axis=0)
                    n[a + o[starts]] += np.diff(np.r_[starts, len(o)])
        return total, n, has

    def best(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """The best language (null: no letter), its log-probability, the log of all languages' summed probabilities, and its likeness."""
        if not self.languages:
            return [None] * len(texts), *(np.zeros(len(texts)) for _ in range(3))
        total, n, has = self.totals(texts)
        k = total.argmax(axis=1)
        top = total[np.arange(len(texts)), k]
        together = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
        span = (self.typical - self.random)[k]
        mean = (top - self.prior[k]) / np.maximum(n, 1)
        like = np.where(span > 0, (mean - self.random[k]) / np.where(span > 0, span, 1), 1.0)
        return [self.languages[j] if h else None for j, h in zip(k, has, strict=True)], top, together, np.where(has, like, 0.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Names and posteriors."""
        names, top, together, _ = self.best([t or "" for t in texts])
        return [x or "und" for x in names], np.where([x is not None for x in names], np.exp(top - together), 0.0)


def train(df: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING, slice_of: int = SLICE) -> list[LanguageModel]:
    """Learn from all rows of ``df`` that have a text and a language: a model for each slice of the languages, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, table in sums.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for a, b in text_slices(batch.column(0), _CHUNK):
                texts, langs = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs], dtype=np.int64)
                for k, name in enumerate(names):
                    sums.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))[buckets] += (code == k).sum()  # documents
                for lo, hi, grams, _ in _counted(texts, orders, buckets):
                    for bucket, owner in grams:
                        table = np.bincount(code[lo:hi][owner] * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
                        for k, name in enumerate(names):
                            sums[name][:buckets] += table[k]
                if len(sums) > SLICE:
                    yield from out()
        yield from out()

    small_batches(df.sparkSession)
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = stage(rows.mapInArrow(tidied(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    documents = {r["lang"]: r["n"] for r in sums.where(F.col("bucket") == buckets).select("lang", "n").collect()}  # a row for each language
    languages = sorted(documents)
    models = []
    for k in range(0, len(languages), slice_of):
        part = languages[k : k + slice_of]
        places = df.sparkSession.createDataFrame(pa.table({"lang": pa.array(part, pa.string()), "at": pa.array(range(len(part)), pa.int32())}))  # of a list, Python workers of another kind would make it, and stay
        table = sums.where((F.col("bucket") < buckets) & F.col("lang").isin(part)).join(F.broadcast(places), "lang").select("bucket", "at", "n").toArrow()
        full = np.zeros((buckets, len(part)))
        full[table.column("bucket").to_numpy(), table.column("at").to_numpy()] = table.column("n").to_numpy()
        models.append(LanguageModel(part, full, np.array([documents[x] for x in part], dtype=float), orders, smoothing, (float(sum(documents.values())), len(languages))))
    unstage(sums)
    return models


def identify(df: DataFrame, model: list[LanguageModel], text: str = "text", prediction: str = "lang_pred", score: str = "lang_score", likeness: str | None = None) -> DataFrame:
    """``df`` with the predicted language, its posterior probability and, if it is named, the likeness; the names must be new.

    Python gets the texts and gives back names and numbers; all other columns stay in the JVM.
    """
    small_batches(df.sparkSession)
    names = df.columns
    clash = {prediction, score, likeness, *(f"{_FOUND}{k}" for k in range(len(model)))} & set(names)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def predictor(part: LanguageModel) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(part)

        def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                out: list[list] = [[], [], [], []]
                for a, b in text_slices(column, _CHUNK):
                    for have, new in zip(out, shared.value.best([t or "" for t in column.slice(a, b - a).to_pylist()]), strict=True):
                        have.extend(new)
                yield pa.StructArray.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.float64()) for x in out[1:])], ["name", "top", "together", "like"])

        predict = tidied(predict)
        predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        # not deterministic, for Spark: else filters on its results would run it again
        return F.arrow_udf(predict, "name string, top double, together double, like double").asNondeterministic()(F.col(text))

    for k, part in enumerate(model):
        df = df.withColumn(f"{_FOUND}{k}", predictor(part))
        if k + 1 < len(model):
            df = stage(df, "languages")  # a task holds one slice of the matrix at a time
    each = [F.col(f"{_FOUND}{k}") for k in range(len(model))]
    if not each:
        lang, p, like = F.lit("und"), F.lit(0.0), F.lit(0.0)
    else:
        best, most = each[0], each[0]["together"]
        for x in each[1:]:
            best = F.when(x["top"] > best["top"], x).otherwise(best)
            most = F.greatest(most, x["together"])
        whole = sum((F.exp(x["together"] - most) for x in each[1:]), F.exp(each[0]["together"] - most)) if len(each) > 1 else F.lit(1.0)
        lang, like = F.coalesce(best["name"], F.lit("und")), best["like"]
        p = F.when(best["name"].isNull(), 0.0).otherwise(F.least(F.exp(best["top"] - most) / whole, F.lit(1.0)))
    added = [lang.alias(prediction), p.alias(score), *([like.alias(likeness)] if likeness else [])]
    return df.select(*names, *added)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null where the key is."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)
