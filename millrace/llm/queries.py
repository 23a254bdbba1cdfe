"""Queries of this subpackage's operators, by name: each applies one with production parameters to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, htmltext, langid, lm, minhash, pieces, quality, suffix, warc
from .common import stage

#: Where the public tokenizers' files lie.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.occurrences(docs, table(spark, sf_dir, "benchmark"))
    hits = decontam.hit_words(F.col("spans"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(langid.fold("doc_id", 5) == 1, F.lit(True))
    return lm.score(docs.withColumn("held_out", held), ~F.col("held_out"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold("doc_id", 3) == 1, F.lit(True))
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model, score="score").drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(True))
    labels = table(spark, sf_dir, "labels").where(~held & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    described = stage(quality.describe(docs, "doc_id"), "statistics")  # texts are read once and never shuffled
    model = quality.fit(described.join(labels, F.col("key") == F.col("doc_id")).select("stats", "label"))
    scored = quality.score(described, model).withColumnRenamed("key", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    proto = pieces.read_model(f"{TOKENIZERS}/{TOKENIZER}")
    decoded = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), proto)
    return decoded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derive(table(spark, sf_dir, "pages"))
    return derived.select(F.col("key").cast("long").alias("page_id"), *[c for c in derived.columns if c != "key"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_language_model": op4_language_model,
    "op5_repeats": op5_repeats,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_main_text": op8_main_text,
    "op9_pieces": op9_pieces,
    "op10_warc": op10_warc,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: DuckDB SQL for the queries that it can express.
ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS g
              FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
        root AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op4_language_model": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} || [' '] AS words FROM documents),
        bits AS (SELECT i, 0 AS k, CAST(i AS UINTEGER) AS c FROM range(256) t(i)
                 UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM bits WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        crc AS (SELECT doc_id, 1 AS k, CAST(doc_id AS VARCHAR) AS v, 4294967295::UINTEGER AS c FROM documents
                UNION ALL SELECT doc_id, k + 1, v, xor(c >> 8, t[CAST(xor(c & 255, CAST(ascii(v[k]) AS UINTEGER)) AS BIGINT) + 1]) FROM crc, tab WHERE k <= length(v)),
        held AS (SELECT doc_id, xor(c, 4294967295::UINTEGER) % 5 = 1 AS held_out FROM crc WHERE k = length(v) + 1),
        t AS (SELECT doc_id, held_out, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] ELSE '  ' END AS v, CASE WHEN i > 2 THEN words[i - 2] WHEN i = 2 THEN '  ' END AS u
              FROM (SELECT doc_id, held_out, words, unnest(range(1, len(words) + 1)) AS i FROM d JOIN held USING (doc_id))),
        c1 AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY ALL),
        c2 AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY ALL),
        c3 AS (SELECT u, v, w, count(*) AS n FROM t WHERE NOT held_out AND u IS NOT NULL GROUP BY ALL),
        h1 AS (SELECT w, n FROM c1 UNION ALL SELECT '  ', count(*) FROM held WHERE NOT held_out),
        z AS (SELECT sum(n) AS n, count(*) AS v FROM c1),
        q AS (SELECT t.doc_id, t.held_out, coalesce(c1.n, 0) AS own, (coalesce(c1.n, 0) + 0.5) / (z.n + 0.5 * (z.v + 1)) AS p1, coalesce(c2.n, 0) AS n2, coalesce(h1.n, 0) AS m2,
                     coalesce(c3.n, 0) AS n3, coalesce(h2.n, 0) AS m3, z.n AS total
              FROM t CROSS JOIN z LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN h1 ON h1.w = t.v
              LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w LEFT JOIN c2 h2 ON h2.v = t.u AND h2.w = t.v),
        b AS (SELECT *, CASE WHEN m2 > 0 THEN (n2 + {lm.STRENGTH}e0 * p1) / (m2 + {lm.STRENGTH}e0) ELSE p1 END AS p2 FROM q)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (own > 0) AS n_known, CAST(any_value(total) AS BIGINT) AS train_tokens, sum(log10(CAST(p1 AS DOUBLE))) AS base_score,
               sum(log10(CAST(CASE WHEN m3 > 0 THEN (n3 + {lm.STRENGTH}e0 * p2) / (m3 + {lm.STRENGTH}e0) ELSE p2 END AS DOUBLE))) AS score
        FROM b GROUP BY doc_id, held_out
    """,
    "op3_decontamination": r"""
        WITH docs AS (SELECT doc_id, row_number() OVER () AS r,
                 list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
        items AS (SELECT item_id,
                 list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
        wins AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, list_slice(words, i, i + least(len(words), 10) - 1) AS w
                 FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT size FROM wins),
        grams AS (SELECT r, i, size, list_slice(words, i, i + size - 1) AS w
                  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, sizes WHERE len(words) >= size)),
        occ AS (SELECT DISTINCT g.r, g.i, g.size, wins.item_id FROM grams g JOIN wins ON g.w = wins.w AND g.size = wins.size),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM occ) GROUP BY r),
        found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
    """,
}
