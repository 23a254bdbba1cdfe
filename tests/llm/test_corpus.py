"""Near duplicates, decontamination, language model, repeats and the pipeline: against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from millrace.llm import blocks, decontam, langid, lm, minhash, queries, suffix
from millrace.llm.components import connected, union_find

SF = "/root/testdata/sf0.001"


def documents(spark, texts, ids=None, extra=False):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + ([T.StructField(n, T.StringType()) for n in ("x", "y", "key", "n")] if extra else []))
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, *("abcd" if extra else ())) for i, t in zip(ids, texts)], schema)


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# components


def test_components_against_union_find(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(70)] + [(500, 600 + i) for i in range(50)]
    nodes, roots = union_find(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    want = {int(a): int(b) for a, b in zip(nodes, roots)}
    got = {x["node"]: x["root"] for x in connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# near duplicates


def brute_components(texts, words, num=80, den=100):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(texts, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_near_duplicates(spark, SF).collect()} == want


def test_near_duplicates_in_chains_and_edges(spark):
    r = random.Random(5)
    base = prose(r, 120).split()
    texts = [None, "", "  \n", "one two", "One  TWO", "three", " ".join(base)]
    for step in range(12):  # each a little further from the first, so that only neighbours are linked
        base = list(base)
        base[8 * step % 120] = f"new{step}"
        texts.append(" ".join(base))
    texts += [prose(r, 50)] * 3 + [prose(r, 3000)]
    df = documents(spark, texts, extra=True)
    got = {x["doc_id"]: (x["n_shingles"], x["component"]) for x in minhash.near_duplicates(df, words=4).collect()}
    assert got == brute_components(list(enumerate(texts)), 4)
    odd = minhash.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", "q r s t u v"], [None, 3, 3])).collect()
    assert sorted((x["doc_id"] or -1, x["component"] or -1) for x in odd) == [(-1, -1), (3, 3), (3, 3)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_signatures_estimate_similarity_and_agree_with_single_steps():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    b = np.r_[a[:240], r.integers(0, 2**63, 60).astype(np.uint64)]
    values = minhash.signatures(np.r_[a, b], np.r_[np.zeros(300, int), np.ones(300, int)], 2, 512)
    assert abs((values[0] == values[1]).mean() - 240 / 360) < 0.08
    # each place holds the smallest of (step + fraction) over the elements' permutations, with or without stopping early
    for n in (1, 3, 40):
        e = a[:n]
        got = minhash.signatures(e, np.zeros(n, int), 1, 16)[0]
        want = np.full(16, np.inf)
        for x in e:
            p = list(range(16))
            for j in range(16):
                d = int(minhash.mix64(np.array([x]) + np.array([j + 1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[0])
                k = j + ((d >> 32) * (16 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j + (d & 0xFFFFFFFF) / 2**32)
        assert np.array_equal(got, want)


# decontamination


def brute_hits(texts, items, window=10):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {}
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for j, x in items:
            v = cut(x)
            size = min(len(v), window)
            wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    found.add(j)
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("small", [50_000, 0])
def test_decontamination_edges(spark, small):
    r = random.Random(7)
    item = prose(r, 25)
    words = item.split()
    items = [(1, item), (2, "Short ÉTUDE item"), (3, None), (4, "--- "), (5, "solo"), (6, prose(r, 12)), (7, "é b")]
    texts = [None, "", item, "x " + " ".join(words[5:16]).upper() + " y", " ".join(words[5:14]), "a short ÉTUDE, item", "a short étude item", "solo", "nothing here", prose(r, 3000) + " " + item + " solo", "é b é b", item]
    docs = documents(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["hit"], sorted(x["items"])) for x in decontam.occurrences(docs, bench, small=small).withColumn("hit", decontam.hit_words(F.col("spans"))).collect()}
    assert got == brute_hits(list(enumerate(texts)), items)
    assert decontam.occurrences(docs.where("false"), bench).count() == 0
    assert [x["items"] for x in decontam.occurrences(docs, bench.where("false")).collect()] == [[]] * len(texts)


def test_decontamination_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op3_decontamination(spark, SF).collect()}
    for i, (n, hit, found) in brute_hits(texts, items).items():
        ids = ",".join(sorted(map(str, found)))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == (n, hit, len(found), hashlib.sha256(ids.encode()).hexdigest(), hit > 0)


# language model


def brute_scores(texts, learned, order=3, s=lm.STRENGTH):
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in texts}
    grams = [Counter() for _ in range(order)]
    for i, w in tokens.items():
        if learned(i):
            x = ["START", *w]
            grams[0].update((k,) for k in w)
            for n in range(2, order + 1):
                grams[n - 1].update(zip(*(x[k:] for k in range(n))))
    starts, total, distinct = sum(map(learned, tokens)), sum(grams[0].values()), len(grams[0])

    def p(context, w):
        if not context:
            return (grams[0][(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
        c = starts if context == ("START",) else grams[len(context) - 1][context]
        lower = p(context[1:], w)
        return (grams[len(context)][(*context, w)] + s * lower) / (c + s) if c else lower

    out = {}
    for i, w in tokens.items():
        x = ["START", *w]
        out[i] = (len(w), sum(grams[0][(k,)] > 0 for k in w), total, sum(math.log10(p((), k)) for k in w), sum(math.log10(p(tuple(x[max(0, k - order + 1) : k]), x[k])) for k in range(1, len(x))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_brute_force(spark, order):
    r = random.Random(9)
    texts = [None, "", " Ab ab AB ", *(prose(r, r.randrange(1, 60), 12) for _ in range(30)), prose(r, 5000, 30), "unseen words only"]
    df = documents(spark, texts, extra=True)
    got = lm.score(df.select("doc_id", "text", "x"), F.col("doc_id") % 3 != 1, order=order, block_bytes=2000).collect()
    want = brute_scores(list(enumerate(texts)), lambda i: i % 3 != 1, order)
    assert len(got) == len(texts)
    for g in got:
        w = want[g["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:3] and abs(g["base_score"] - w[3]) < 1e-6 and abs(g["score"] - w[4]) < 1e-6 and g["x"] == "a"


def test_scores_edges(spark):
    df = documents(spark, ["a b", None, "a b"], [None, 4, 4])
    out = lm.score(df, F.col("doc_id") == 4).collect()
    assert len(out) == 3 and {r["train_tokens"] for r in out} == {4}
    assert lm.score(df.where("false"), F.lit(True)).count() == 0
    none = lm.score(df, F.lit(None).cast("boolean")).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_scores_of_bigrams_with_near_keys(spark):
    """The first 56 bits of the hashes of the two bigrams are the same."""
    a, b = "w16302 w3761", "w17646 w19944"
    keys = [list(lm.Tokens(pa.chunked_array([[t]])).grams(2))[1][1] for t in (a, b)]
    assert keys[0] != keys[1] and keys[0] >> np.uint64(8) == keys[1] >> np.uint64(8)
    texts = [a, a, "w17646 x", b]
    want = brute_scores(list(enumerate(texts)), lambda i: i < 3)
    assert all(abs(g["score"] - want[g["doc_id"]][4]) < 1e-6 for g in lm.score(documents(spark, texts), F.col("doc_id") < 3).collect())


def test_squeezed_texts_come_back(spark):
    texts = ["", None, "Größe 漢字 \U0001f600", "a" * 100_000]
    back = lm.unsqueezed(documents(spark, texts).select(lm.squeezed(F.col("text").cast("binary")).alias("t")).toArrow().column("t"))
    assert sorted(back.to_pylist()) == sorted(t or "" for t in texts)


def test_held_out_texts_score_better_than_the_base(spark):
    out = queries.op4_language_model(spark, SF).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


# repeats


def test_previous_factors_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        n, d = r.randint(1, 60), r.choice([3, 7, 10, 20, 100])
        s = [r.randint(1, 3) for _ in range(n)]
        factor, where = suffix.previous_factors(np.array(s), d)
        for i in range(n):
            best = 0
            for j in range(i):
                k = 0
                while i + k < n and s[i + k] == s[j + k] and k < d:
                    k += 1
                best = max(best, k)
            assert factor[i] == best
            if best:
                j = where[i]
                assert j < i and s[j : j + best] == s[i : i + best]


def brute_repeats(rows, length):
    """(bytes, removed, spans, kept) of each row, in the order given."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length,block_bytes", [(100, 3000), (100, 1 << 20), (40, 500)])
def test_repeats_against_brute_force(spark, length, block_bytes):
    r = random.Random(11)
    passage, other = prose(r, 60), prose(r, 90)
    texts = [None, "", "short", passage, prose(r, 20) + passage + prose(r, 20), "é" * 400, "ab" * 300, other, other[:200] + "X" + other[201:], other, "a" * 99, "a" * 100, "a" * 250]
    for _ in range(25):
        cut = r.randrange(len(other) - 50)
        texts.append(prose(r, r.randrange(30)) + other[cut:] + passage[: r.randrange(200)] + prose(r, 3))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = sorted(zip(ids, texts), key=lambda x: x[0])
    got = suffix.remove_repeats(documents(spark, texts, ids, extra=True), length=length, block_bytes=block_bytes).collect()
    want = dict(zip([i for i, _ in rows], brute_repeats(rows, length)))
    assert {g["doc_id"]: (g["n_bytes"], g["n_removed"], len(g["removed"]), bytes(g["kept"])) for g in got} == want
    assert all(sum(s["end"] - s["start"] for s in g["removed"]) == g["n_removed"] for g in got)


def test_a_scan_holds_each_run_of_strings_once():
    """A block's notes on its strings take fewer bytes than its texts, whatever these are; they stand for all strings."""
    r = np.random.default_rng(4)
    for texts in ([r.integers(32, 127, 3_000_000)], [np.full(1_500_000, 97)], [r.integers(97, 100, n) for n in r.integers(0, 400, 8000)]):
        data, offsets = np.concatenate(texts).astype(np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
        scan = suffix.Scan(data, offsets, 100)
        want = np.concatenate([np.arange(a, max(a, b - 99)) for a, b in zip(offsets[:-1], offsets[1:])])
        assert np.array_equal(scan.strings(np.ones(len(scan.hash), dtype=bool)), want)
        if len(texts) == 1 and data[0] != data[1]:
            assert sum(x.nbytes for x in vars(scan).values()) < 2 * len(data)


def test_covered_bytes_against_brute_force():
    r = np.random.default_rng(6)
    n = 3 * suffix._CHUNK // 2
    at = np.sort(r.choice(n - 300, 40_000, replace=False))
    at, more = at[::2], np.unique(np.r_[at[1::2], suffix._CHUNK - 50])
    delta, want = np.zeros(n + 1, dtype=np.int8), np.zeros(n, dtype=bool)
    suffix._cover(delta, at, 100)
    suffix._cover(delta, more, 100)
    for x in (*at, *more):
        want[x : x + 100] = True
    assert np.array_equal(suffix._covered(delta), want)


def test_repeats_edges(spark):
    t = prose(random.Random(1), 40)
    rows = suffix.remove_repeats(documents(spark, [t, t, t], [5, None, 5])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"] > 0) for r in rows) == [(-1, False), (5, True), (5, True)]
    assert suffix.remove_repeats(documents(spark, [t]).where("false")).count() == 0
    r = random.Random(4)
    w = "".join(r.choice("éèàçùñ") for _ in range(80))
    text = suffix.remove_repeats(documents(spark, [w + "é", "x" + w, w + "è"]), as_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in text} == {0: w + "é", 1: "x", 2: ""}  # half a character is left of the last


def test_repeats_with_hot_and_null_keys_in_many_blocks(spark):
    r = random.Random(8)
    passage = prose(r, 60)
    rows = [(k, prose(r, 30) + passage[: r.randrange(len(passage))] + prose(r, 8)) for k in [None] * 40 + [7] * 40 + list(range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, n = blocks.deal(docs, "doc_id", "text", 2000)
    sizes = {x["_block"]: x["b"] for x in dealt.groupBy("_block").agg(F.sum(F.length("text")).alias("b")).collect()}
    assert len(sizes) > 10 and max(sizes) < n and max(sizes.values()) < 8000
    order = {(x["doc_id"], x["text"]): (x["doc_id"] is not None, x["doc_id"] or 0, x["_tie"], x["text"]) for x in dealt.collect()}
    rows.sort(key=lambda x: order[x])
    got = suffix.remove_repeats(docs, block_bytes=2000).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((g["doc_id"], bytes(g["kept"])) for g in got), key=key) == sorted(((k, x[3]) for (k, _), x in zip(rows, brute_repeats(rows, 100))), key=key)


def test_key_messages_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    back = np.concatenate([blocks.unpack_keys(m[2], m[1]) for m in blocks.messages(0, keys, None, 7)])
    assert np.array_equal(back, keys) and len(blocks.messages(0, keys[:0], None, 7)) == 7
    assert len(blocks.posted(3, blocks.messages(0, keys, None, 7), blocks.messages(1, keys, keys, 7))) == 7


def test_keys_with_other_checks_are_others():
    keys = np.array([5, 5, 9], dtype=np.uint64)
    sent = [m for block, checks in enumerate(([1, 2, 3], [2, 4, 3])) for m in blocks.posted(block, blocks.messages(0, keys, np.ones(3, dtype=np.int64), 1, np.array(checks, dtype=np.uint32)))]
    table = blocks.add_up(blocks.table_of(sent, blocks.MESSAGE))
    one, two = (blocks.Answers(table.filter(pc.field(blocks.BLOCK) == block)) for block in (0, 1))
    assert one.totals(0).tolist() == [1, 2, 2] and two.totals(0).tolist() == [2, 1, 2]
    assert one.first(0).tolist() == [True, True, True] and two.first(0).tolist() == [False, True, False]


def test_totals_beyond_32_bits():
    keys = np.array([3, 2**63, 2**64 - 1], dtype=np.uint64)
    sent = [m for block, counts in enumerate(([2**32 - 1, 1, 0], [2**32 - 1, 2, 2**40])) for m in blocks.posted(block, blocks.messages(0, keys, np.array(counts), 1))]
    table = blocks.add_up(blocks.table_of(sent, blocks.MESSAGE))
    for block in (0, 1):
        answers = blocks.Answers(table.filter(pc.field(blocks.BLOCK) == block))
        assert answers.totals(0).tolist() == [2**33 - 2, 3, 2**40] and answers.sums(0) == (3, 2**33 + 1 + 2**40)


def test_repeats_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = {i: (n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, brute_repeats(rows, 100))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_repeats(spark, SF).collect()} == want


# the pipeline


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    named = langid.identify(docs, langid.train(docs), prediction="l", score="s").where("l <> 'und' and s >= 0.5")
    texts = {r["doc_id"]: r["text"] for r in named.collect()}
    texts = {i: texts[i] for i, (_, c) in brute_components(list(texts.items()), 5).items() if i == c}
    rows = sorted(texts.items())
    texts = {i: k.decode("utf-8", "ignore") for (i, _), (_, _, _, k) in zip(rows, brute_repeats(rows, 100))}
    texts = {i: texts[i] for i, (_, hit, _) in brute_hits(list(texts.items()), items).items() if not hit}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in out} == texts
    assert all(r["round_trip"] and r["n_chars"] == len(r["text"]) and r["n_ids"] == len(r["ids"]) for r in out)


def test_texts_in_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(4)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмнопрстуфхцчшщъыьэюя ", "".join(chr(0x4E00 + i) for i in range(3000))]
    odd = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (30, 200, 3000) for _ in range(5)]
    n = len(docs.columns) - 2
    more = docs.union(spark.createDataFrame([(-1 - i, t, *[None] * n) for i, t in enumerate(odd)], docs.schema))
    kept = {x["doc_id"] for x in corpus_pipeline.language(spark, more, SF).collect()}
    assert kept == {x["doc_id"] for x in docs.collect()}


def test_stages_with_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = "component rep at h bytes hash n_words spans items kept removed n_bytes n_removed _block _null _text _new _lang _score _hash rest".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, " + ", ".join(f"{n} long" for n in more)
    some = [(None,) * (6 + len(more)), *[(1, "the words of a text", "en", "s", 19, "k", *[7] * len(more))] * 2, (2, "", "en", None, 0, None, *[None] * len(more))]
    for rows in (some, []):
        docs = spark.createDataFrame(rows, schema)
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert all(r["_null"] == r["rest"] == r["_text"] for r in out.collect())


def test_a_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    from millrace.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {}
    for name, run in (("near", lambda: minhash.near_duplicates(docs)), ("languages", lambda: langid.train(docs)), ("pipeline", lambda: corpus_pipeline.run(spark, SF).count())):
        seen = {p.name for p in tmp_path.iterdir()}
        run()
        left[name] = sorted(p.name.split("-")[1] for p in tmp_path.iterdir() if p.name not in seen)
    assert left == {"near": ["components", "sketches"], "languages": [], "pipeline": ["decontamination"]}
