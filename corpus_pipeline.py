"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Where a stage changes texts, ``n_chars`` follows. Columns that documents have beyond these pass through, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, minhash, pieces, suffix
from millrace.llm.common import free, stage, staged_whole, unstage
from millrace.llm.queries import TOKENIZER, TOKENIZERS, table

#: Documents whose best language has a smaller posterior are rejected, as are those without a letter.
LEAST_POSTERIOR = 0.5
#: So are documents of a smaller likeness: at scale 0.01 clean texts cut to five characters have 0.69 or more, 30 random Latin letters 0.59 or less.
LEAST_LIKENESS = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language. The model learns from all documents with a language; null and letterless texts go."""
    model = langid.train(docs)
    lang, score, like = (free(x, docs.columns) for x in ("_lang", "_score", "_like"))
    named = langid.identify(docs, model, prediction=lang, score=score, likeness=like)
    return named.where((F.col(lang) != "und") & (F.col(score) >= LEAST_POSTERIOR) & (F.col(like) >= LEAST_LIKENESS)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest key of each group of near duplicates. Rows of a null key or without words are in no group and stay."""
    found = minhash.near_duplicates(docs)
    gone = found.where("doc_id <> component").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that occurred before. Characters that a cut would split go as a whole; nulls stay null.

    Of columns only the key, the text and all others as one struct take part, so none can clash with a name of the operator's.
    """
    null = free("_null", docs.columns)
    rest = F.struct(*[c for c in docs.columns if c != "text"], F.col("text").isNull().alias(null)).alias("rest")
    cut = suffix.remove_repeats(docs.select("doc_id", "text", rest), as_text=True)
    text = F.when(~F.col("rest").getField(null), F.col("kept"))
    return cut.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. What is dropped follows from a text alone; null texts stay."""
    names = [free(f"_{k}", docs.columns) for k in decontam.TEXT_KEY]
    keys = [k.alias(n) for k, n in zip(decontam.identity(F.col("text")), names, strict=True)]
    found = decontam.occurrences(docs.select("text", *keys), table(spark, sf_dir, "benchmark"))
    gone = stage(found.where(F.size("items") > 0).select(*names).distinct(), "dirty")
    few = gone.count() <= decontam.FEW  # then texts need no shuffle
    return docs.select(*docs.columns, *keys).join(F.broadcast(gone) if few else gone, names, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts, and whether decoding gives the text back; a null text has null ids and counts as given back."""
    proto = pieces.read_model(f"{TOKENIZERS}/{TOKENIZER}")
    done = pieces.encode_and_decode(docs, proto)
    return done.select(*docs.columns, "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", benchmark), ("pieces", encode)]

#: Training, signatures and merges can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        before, docs = docs, staged_whole(lambda: apply(spark, docs, sf_dir), name)  # noqa: B023  called at once
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
