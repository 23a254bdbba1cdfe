"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item becomes windows of ``window`` consecutive words (an item of fewer words is one window), and a window is
a set of shingles of up to ``shingle`` words with their places. Shingles are ordered by rarity, counted over all
documents. As an occurrence contains the whole window, the prefix that must be shared is a window's rarest shingle. Joining
documents with the prefixes on that shingle's hash gives candidates (texts that are copies of each other once); the shingle's place in the window gives the start,
which must leave room before and behind it (positional and length bounds); and the words of the document there must
equal the window's, which is the exact check, so collisions of shingle hashes have no effect. Copies of a text are known by 128 bits of
hash and their length.

The benchmark's shingles and windows are broadcast while they are fewer than ``small`` (their size is checked first); a
larger benchmark is joined by shuffles on the shingle's hash, which for hot shingles AQE can split.

Defined results: null texts have no words; null items, items without words and items of null id are never found; repeated
windows and items count once; each input row gives a row, with repeated rows alike; empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII letters and digits and all other characters beyond ASCII make words; fixed by the task.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Benchmark shingles up to which they are broadcast: with their windows they take some tens of MB.
SMALL = 50_000
#: Texts with candidates up to which their keys (24 bytes each) are broadcast, so that no other texts are shuffled; more are joined by shuffles.
FEW = 500_000


def words(text: Column) -> Column:
    """Words of a text, lower-cased A-Z; null as none."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


#: What names a text: two hashes of 64 bits and its length, so that copies of a text are checked once.
TEXT_KEY = ["hash", "hash2", "bytes"]


def identity(text: Column) -> list[Column]:
    """TEXT_KEY of a text; equal for nulls. The second hash is seeded by a number hashed before the text."""
    return [F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(7), text).alias("hash2"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("bytes")]


def _hash(parts: list[Column], size: int) -> Column:
    """The hash of a shingle; null where it would run past the end."""
    return F.when(parts[size - 1].isNotNull(), F.xxhash64(*parts[:size], F.lit(size)))


def _runs(words: Column, size: int) -> Column:
    """(w0, w1, ...): each word with those behind it, null past the end."""
    return F.arrays_zip(*[(words if k == 0 else F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1)))).alias(f"w{k}") for k in range(size)])


def _shingles(words: Column, size: int) -> Column:
    """(place from 0, hash) of all runs of ``size`` words."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(words, i + k) for k in range(size)], F.lit(size)).alias("h")))


def windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """item_id, words of each distinct window (``w``)."""
    split = items.select(F.col(key).alias("item_id"), words(F.col(text)).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, window))).alias("w")).distinct()


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """``docs`` (without the text) with n_words, spans (array of start and length, in words) and items (array of item ids).

    ``docs`` may hold any other columns but these three.
    """
    rest = [c for c in docs.columns if c != text]
    if clash := {"n_words", "spans", "items"} & set(rest):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    found = windows(items, item_key, item_text, window)
    wide = found.withColumn("size", F.least(F.size("w"), F.lit(shingle)))
    sizes = sorted(r["size"] for r in wide.select("size").distinct().collect())  # up to ``shingle`` numbers
    named = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    base = docs.select(named.alias("doc"), F.col(text).alias("text"), *identity(F.col(text)))
    id_array = f"array<{items.schema[item_key].dataType.simpleString()}>"
    spans_array = "array<struct<at:int,size:int>>"
    if not sizes:
        nothing = base.select("doc", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.array().cast(spans_array).alias("spans"), F.array().cast(id_array).alias("items"))
        return _named(nothing, rest)
    tokens = None
    for s in sizes:
        part = wide.where(F.col("size") == s).select("item_id", "w", F.explode(_shingles(F.col("w"), s)).alias("s"))
        tokens = part if tokens is None else tokens.union(part)
    tokens = tokens.select("item_id", "w", F.col("s.at").alias("offset"), F.col("s.h").alias("h"))
    known = tokens.select("h").distinct()
    some = known.limit(small + 1).collect()
    is_small = len(some) <= small
    fit = F.broadcast if is_small else (lambda x: x)

    # one pass over all texts: places of the benchmark's shingles, and a leading row for each document
    split = base.select("doc", *TEXT_KEY, words(F.col("text")).alias("words"))
    each = split.select("doc", *TEXT_KEY, F.size("words").alias("n_words"), F.posexplode_outer(_runs(F.col("words"), max(sizes))).alias("at", "run"))
    hashes = [(s, _hash([F.col(f"run.w{k}") for k in range(s)], s)) for s in sizes]
    lead = F.coalesce(F.col("at") == 0, F.lit(True))
    if is_small:
        listed = [r["h"] for r in some]
        hit = {s: F.coalesce(h.isin(listed), F.lit(False)) for s, h in hashes}
        any_hit = lead
        for h in hit.values():
            any_hit = any_hit | h
        found_at = F.array_compact(F.array(*[F.when(hit[s], h) for s, h in hashes]))
        places = each.where(any_hit).select(F.when(lead, F.col("doc")).alias("doc"), *TEXT_KEY, "n_words", "at", lead.alias("lead"), found_at.alias("hs"))
    else:
        exploded = each.select(F.when(lead, F.col("doc")).alias("doc"), *TEXT_KEY, "n_words", "at", lead.alias("lead"), F.explode_outer(F.array_compact(F.array(*[h for _, h in hashes]))).alias("h"))
        kept = exploded.join(known.withColumn("known", F.lit(True)), "h", "left").where("lead or known")
        places = kept.select("doc", *TEXT_KEY, "n_words", "at", "lead", F.when(F.col("known"), F.array("h")).otherwise(F.array().cast("array<bigint>")).alias("hs"))
    places = stage(places, "places")
    hits = places.select(*TEXT_KEY, "at", F.explode("hs").alias("h"))

    # rarity over all documents; each window's rarest shingle is its prefix
    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(counts, "h")
    all_there = tokens.groupBy("item_id", "w").agg(F.count_distinct("h").alias("need"))
    prefix = ranked.groupBy("item_id", "w").agg(F.min(F.struct("n", "h", "offset")).alias("p"), F.count_distinct("h").alias("have"))
    prefix = prefix.join(all_there, ["item_id", "w"]).where("have = need")  # else it occurs nowhere
    index = prefix.groupBy(F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), "w").agg(F.collect_set("item_id").alias("of"))

    # candidates: a text once for all its copies; the start must leave room for the window
    texts = places.select(*TEXT_KEY, "n_words").distinct()
    start = F.col("at") - F.col("offset")
    candidates = hits.distinct().join(fit(index), "h").join(texts, TEXT_KEY).where((start >= 0) & (start + F.size("w") <= F.col("n_words")))
    candidates = stage(candidates.groupBy(*TEXT_KEY).agg(F.collect_set(F.struct(start.alias("at"), "w", "of")).alias("candidates")), "candidates")
    few = F.broadcast if candidates.count() <= FEW else (lambda x: x)
    wanted = base.select(*TEXT_KEY, "text").join(few(candidates.select(*TEXT_KEY)), TEXT_KEY, "left_semi").groupBy(*TEXT_KEY).agg(F.first("text").alias("text"))
    checked = wanted.join(candidates, TEXT_KEY).select(*TEXT_KEY, words(F.col("text")).alias("words"), "candidates")
    exact = checked.select(*TEXT_KEY, F.filter("candidates", lambda c: F.slice(F.col("words"), c["at"] + 1, F.size(c["w"])) == c["w"]).alias("occ"))
    exact = exact.select(
        *TEXT_KEY,
        F.array_distinct(F.transform("occ", lambda c: F.struct(c["at"].alias("at"), F.size(c["w"]).alias("size")))).alias("spans"),
        F.array_distinct(F.flatten(F.transform("occ", lambda c: c["of"]))).alias("items"),
    )
    exact = stage(exact, "exact")  # so that the join's sides are no aggregates, and AQE can split a hot text
    lines = places.where("lead").select("doc", F.col("n_words").cast("long").alias("n_words"), *TEXT_KEY).join(exact, TEXT_KEY, "left")
    return _named(lines.select("doc", "n_words", F.coalesce("spans", F.array().cast(spans_array)).alias("spans"), F.coalesce("items", F.array().cast(id_array)).alias("items")), rest)


def _named(df: DataFrame, rest: list[str]) -> DataFrame:
    return df.select(*[F.col("doc").getField(c).alias(c) for c in rest], "n_words", "spans", "items")


def hit_words(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))).cast("long")
