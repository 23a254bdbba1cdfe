"""Language ID, quality, HTML, pieces, WARC and neighbours: against brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import json
import math
import random
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import ann, common, htmltext, langid, pieces, quality, queries, warc
from millrace.llm.common import ByteHash, chunks, lower_ascii, utf8, word_bounds

SF = "/root/testdata/sf0.001"
MODEL = f"{queries.TOKENIZERS}/{queries.TOKENIZER}"


def documents(spark, texts, **extra):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(k, T.StringType()) for k in extra])
    return spark.createDataFrame([(i, t, *(v[i] for v in extra.values())) for i, t in enumerate(texts)], schema)


def test_word_bounds_and_hashes():
    texts = ["", "a", " Ab  cD\x0b", "é x y", "end"]
    import pyarrow as pa

    data, offsets = utf8(pa.array([*texts[:1], None, *texts[1:]]))
    starts, ends, first = word_bounds(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["a", "Ab", "cD", "é", "x y", "end"] and list(first) == [0, 0, 0, 1, 3, 5, 6]
    h = ByteHash(lower_ascii(np.frombuffer(b"abcXabC", dtype=np.uint8)))
    out = h(np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert out[0] == out[1] != out[2]
    assert [c for c in chunks(np.array([0, 5, 6, 20]), 6)] == [(0, 2), (2, 3)]


# language


def test_language_on_held_out_texts(spark):
    found = queries.op6_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(found) == 200 and (held.lang_pred == held.lang).mean() > 0.95 and found.score.between(0, 1).all()


def test_language_starts_no_second_kind_of_workers(spark, monkeypatch):
    """Small tables of the driver's go to the JVM as Arrow tables; of lists, Spark makes them by workers that take memory until the end."""
    make, given = type(spark).createDataFrame, []
    docs = documents(spark, ["the cat sat", "le chat est"], lang=["en", "fr"])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: given.append(type(data)) or make(self, data, *a, **k))
    assert langid.train(docs)[0].languages == ["en", "fr"] and given == [pa.Table]


def test_language_edges(spark):
    df = documents(spark, ["the cat sat on the mat " * 3, "le chat est sur la table " * 3, None, "", "12 34 !!", "ß" * 5000, "the cat"], lang=["en", "fr", "en", None, "en", None, None])
    model = langid.train(df)
    out = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [out[i]["lang_pred"] for i in range(5)] == ["en", "fr", "und", "und", "und"] and out[6]["lang_pred"] == "en"
    assert out[2]["lang_score"] == 0 and out[5]["lang_pred"] in ("en", "fr")
    nothing = langid.train(df.where("false"))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        langid.identify(df.withColumn("lang_pred", F.lit(1)), model)


def test_language_scores_match_brute_force():
    """The sparse batch scores are those of naive Bayes computed n-gram by n-gram."""
    texts = ["ab ba", "abba", "Xy!"]
    counts = np.random.default_rng(0).integers(0, 9, (64, 2)).astype(float)
    model = langid.LanguageModel(["p", "q"], counts, np.array([3.0, 1.0]), (1, 2), 0.5)
    names, scores = model.predict(texts)
    for t, name, s in zip(texts, names, scores):
        grams, _ = langid.ngrams([t], (1, 2), 64)
        total = model.prior + sum(model.logp[b] for bucket, _ in grams for b in bucket)
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert name == "pq"[int(p.argmax())] and abs(s - p.max()) < 1e-9


def test_language_of_long_texts_in_parts(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcé  .,X\n") for _ in range(5000)) + "x" * 900 + " 12 " * 50
    whole, has = langid.ngrams([text], (1, 2, 3), 1 << 12)
    monkeypatch.setattr(langid, "_LONG", 100)
    for t, want in ((text, whole), ("!" * 900, None), ("a" * 700, None)):
        want = want or langid.ngrams([t], (1, 2, 3), 1 << 12)[0]
        parts = list(langid.long_ngrams(t, (1, 2, 3), 1 << 12))
        for k in range(3):
            assert np.array_equal(np.concatenate([grams[k][0] for grams, _ in parts]), want[k][0])
    assert has[0] and len(list(langid.long_ngrams(text, (1,), 4))) > 10


def test_many_languages_in_slices(spark):
    """600 languages, each of a word of its own: slices of the matrix give what the whole one gives."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(600)]
    df = documents(spark, [f"{w} {w}" for w in words], lang=[f"l{k:03}" for k in range(600)])
    sliced, whole = langid.train(df), langid.train(df, slice_of=1000)
    assert [len(m.languages) for m in sliced] == [128] * 4 + [88] and len(whole) == 1
    a, b = ({r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(df, m).collect()} for m in (sliced, whole))
    assert all(a[k][0] == b[k][0] == f"l{k:03}" and abs(a[k][1] - b[k][1]) < 1e-9 for k in range(600))


def test_language_ties_and_clashing_names(spark):
    df = documents(spark, ["same words", "same words"], lang=["b", "a"], top=["x", "y"])
    out = langid.identify(df, langid.train(df)).collect()
    assert [r["lang_pred"] for r in out] == ["a", "a"] and [r["top"] for r in out] == ["x", "y"] and out[0]["lang_score"] == out[1]["lang_score"]


def test_training_against_counts_by_hand(spark):
    texts, langs = ["ab ba", "Abba!", "xy", None, "zz"], ["p", "q", "p", "p", None]
    (model,) = langid.train(documents(spark, texts, lang=langs), orders=(1, 2), buckets=1 << 10)
    counts = {k: np.zeros(1 << 10) for k in "pq"}
    for t, x in zip(texts, langs):
        if t and x:
            grams, _ = langid.ngrams([t], (1, 2), 1 << 10)
            for bucket, _ in grams:
                np.add.at(counts[x], bucket, 1)
    for k, x in enumerate("pq"):
        want = np.log(counts[x] + langid.SMOOTHING) - np.log(counts[x].sum() + langid.SMOOTHING * (1 << 10))
        assert np.allclose(model.logp[:, k], want, atol=1e-12)
    assert np.allclose(model.prior, np.log([3 / 5, 2 / 5]))


# quality


def test_fit_against_ridge_and_isotonic_by_hand(spark):
    r = np.random.default_rng(4)
    stats = r.normal(size=(300, len(quality.STATISTICS)))
    label = (stats[:, 0] + 0.3 * r.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label)], "stats array<double>, label int").repartition(5)
    model = quality.fit(df)
    plain = quality.QualityModel()
    plain.mean, plain.scale = stats.mean(axis=0), stats.std(axis=0)
    z = plain.expand(stats)
    weights = np.linalg.solve(z.T @ z + plain.ridge * len(z) * np.eye(z.shape[1]) / z.shape[1], z.T @ label)
    assert np.allclose(model.weights, weights, atol=1e-8)
    scores = model.score(stats)
    order = np.argsort(z @ weights)
    assert (np.diff(scores[order]) >= -1e-12).all()
    bins = np.clip((z @ weights - quality._LOW) / (quality._HIGH - quality._LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    means = [[label[bins == b].sum(), (bins == b).sum()] for b in np.unique(bins)]
    while any(p[0] * q[1] > q[0] * p[1] for p, q in zip(means, means[1:])):  # pool neighbours that fall, one pair at a time
        k = next(k for k, (p, q) in enumerate(zip(means, means[1:])) if p[0] * q[1] > q[0] * p[1])
        means[k : k + 2] = [[means[k][0] + means[k + 1][0], means[k][1] + means[k + 1][1]]]
    assert np.allclose(np.unique(np.round(model.y, 9)), np.unique(np.round([a / b for a, b in means], 9)))
    assert quality.fit(df.where("false")).score(stats[:3]).tolist() == [0.5] * 3


def test_statistics_against_plain_counts(monkeypatch):
    from millrace.llm import common

    r = random.Random(6)
    texts = ["".join(r.choice("aB c1.!\n#|é ") for _ in range(n)) for n in (0, 1, 5, 400, 3000)]
    texts += ["dog dog cat\ndog dog cat\nThe end of it"]
    import pyarrow as pa

    data, offsets = utf8(pa.array(texts))
    got = quality.statistics(data, offsets)
    for t, s in zip(texts, got):
        b, w, lines = t.encode(), t.split(), [x for x in t.split("\n")]
        lines = lines[:-1] if t.endswith("\n") else lines
        low = [x.encode().lower() for x in w]
        n = dict(zip(quality.STATISTICS, s))
        if not b:
            assert not s.any()
            continue
        assert abs(n["digits"] - sum(48 <= c <= 57 for c in b) / len(b)) < 1e-12 and abs(n["capitals"] - sum(65 <= c <= 90 for c in b) / len(b)) < 1e-12
        assert abs(n["log_words"] - math.log1p(len(w))) < 1e-12 and abs(n["distinct"] - len(set(low)) / max(len(w), 1)) < 1e-12
        assert abs(n["common"] - max([low.count(x) for x in low], default=0) / max(len(w), 1)) < 1e-12
        assert abs(n["pairs"] - len(set(zip(low, low[1:]))) / max(len(w), 1)) < 1e-12
        assert abs(n["distinct_lines"] - len({x.lower() for x in lines}) / len(lines)) < 1e-12
    monkeypatch.setattr(common, "CHUNK_BYTES", 64)  # the same in slices
    assert np.array_equal(quality.statistics(data, offsets), got)


def test_quality_on_held_out_labels(spark):
    found = queries.op7_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert len(found) == 1000 and (held.predicted == held.quality).mean() > 0.9 and found.score.between(0, 1).all()


def test_quality_edges(spark):
    df = documents(spark, [None, "", "one", "w " * 50_000, "A!! B!!"])
    described = quality.describe(df, "doc_id")
    assert all(np.isfinite(r["stats"]).all() for r in described.collect())
    untaught = quality.fit(described.select("stats", F.lit(None).cast("int").alias("label")))
    assert {r["score"] for r in quality.score(described, untaught).collect()} == {0.5}
    one = quality.fit(described.select("stats", F.lit(1).alias("label")))
    assert all(r["score"] > 0.9 for r in quality.score(described, one).collect())


def test_isotonic_means():
    x, y = quality.pool_adjacent_violators(np.arange(5.0), np.array([0.0, 2, 1, 3, 3]), np.array([1.0, 2, 2, 3, 3]))
    assert list(y) == sorted(y) and abs(y[0]) < 1e-12 and abs(y[1] - 0.75) < 1e-12 and y[-1] == 1


def test_fourier_features_approximate_the_kernel():
    model = quality.QualityModel(features=4096)
    z = np.random.default_rng(1).normal(size=(6, len(quality.STATISTICS)))
    f = model.expand(z)[:, :-1]
    exact = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * quality.BANDWIDTH**2))
    assert np.abs(f @ f.T - exact).max() < 0.1


# pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


LONG = "Some words of the main text that go on for a while, as texts do, with commas and all. " * 3
OTHER = "Another paragraph follows with more of the same, long enough to look like a text. " * 3


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p><b>Lead<br><p>{LONG}</p></article><footer>&copy; x</footer>", f"Head Lead {LONG}"),
        (f"<header><h2>Site</h2></header><main><p>{LONG}<p>{OTHER}</main><aside>Ads</aside>", f"{LONG} {OTHER}"),
        (f"<div class='cookie-notice'>{LONG}</div><div id=content><p>{OTHER}</p><p>{LONG}</p></div><section id='comments'><p>{OTHER}</p></section>", f"{OTHER} {LONG}"),
        (f"<div><ul><li><a href=1>one link</a><li><a href=2>two links</a></ul></div><div><p>{LONG}</p><p>a &amp; b&nbsp;&lt;c&gt; {OTHER}</p></div><form>Name <input></form>", f"{LONG} a & b <c> {OTHER}"),
        (f"<article><p>x<script>var a='</p>';</script>y {LONG}<style>p{{}}</style><!-- no --></p><div class=ad>buy</div></article>", f"xy {LONG}"),
        (f"<article><header><h1>Head</h1></header><p>{LONG}<ul><li>a<li>b</ul></article>", f"Head {LONG} a b"),
    ],
)
def test_main_text(body, expected):
    assert htmltext.main_text(page(body)) == " ".join(expected.split())


def test_main_text_of_odd_pages():
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<html></html>") == htmltext.main_text("<script>x") == ""
    assert htmltext.main_text("just words") == "just words"
    assert htmltext.main_text("<p>open <b>bold <i>both</p><p>next") == "open bold both next"
    assert htmltext.main_text("<a href='x>y'>t</a> <p>" + LONG) .endswith(LONG.strip())
    deep = "<div>" * 5000 + "<p>" + LONG + "</p>" + "</div>" * 5000
    assert htmltext.main_text(deep) == LONG.strip()


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar entry", "main-content with-comments", "article-widget", "post comments-open", "layout sidebarNone share"])
def test_wrappers_with_words_of_other_parts(name):
    rest = "<div class='sidebar'><p>Most read</p></div><section class=comments><p>Nice one, says a reader.</p></section><div class='share'>Share this</div>"
    assert htmltext.main_text(page(f"<nav><a href=x>Home</a></nav><div class='{name}'><h1>Head</h1><p>{LONG}</p><p>{OTHER}</p>{rest}</div>")) == " ".join(f"Head {LONG} {OTHER}".split())
    assert htmltext.main_text(page(f"<div class='ad {name}'><article><p>{LONG}</p></article></div><div class=ad>{OTHER}</div>")) == LONG.strip()


def test_hints_do_not_empty_a_page():
    assert htmltext.main_text(page(f"<div class='comments'><p>{LONG}</p></div>")) == LONG.strip()
    assert htmltext.main_text(page(f"<div id=comments><article class=comment>{OTHER}{OTHER}</article></div><article>{LONG}</article>")) == LONG.strip()


def test_raw_elements_end_in_any_case():
    assert htmltext.main_text(f"<body>İ<script>x</scriptless>y</SCRIPT ><p>{LONG}</p><STYLE>p</Style>") == "İ " + LONG.strip()


def test_density_against_brute_force():
    root = htmltext.parse(page(f"<div><a href=1>one</a> two <p>{LONG}<a href=2>three</a></p><ul><li>x<li><a href=3>y</a></ul></div><p>{OTHER}<b>z</b></p>"))
    for node in htmltext._measure(root):
        pass

    def strings(n, linked=False):
        for c in n.children:
            if isinstance(c, str):
                yield "".join(c.split()), linked or n.tag == "a"
            else:
                yield from strings(c, linked or n.tag == "a")

    def tags(n):
        return [x for c in n.children if not isinstance(c, str) for x in [c.tag, *tags(c)]]

    body = next(n for n in _nodes(root) if n.tag == "body")
    of = lambda n: (sum(len(s) for s, _ in strings(n)), max(len(tags(n)), 1), sum(len(s) for s, link in strings(n) if link), max(tags(n).count("a"), 1))
    whole = of(body)
    for n in _nodes(root):
        c, t, lc, lt = of(n)
        if c and c * t > max(lc, 1) * lt:
            want = c / t * math.log(c / max(lc, 1) * t / lt) / math.log(math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e))
        else:
            want = 0
        assert abs(n.density - want) < 1e-9
    assert all(abs(n.sum - sum(c.density for c in n.children if not isinstance(c, str))) < 1e-9 for n in _nodes(root))


def _nodes(root):
    yield root
    for c in root.children:
        if not isinstance(c, str):
            yield from _nodes(c)


class _Articles(HTMLParser):
    """Blocks of a page's article, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.skip = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style") or (self.skip and tag == "div") or dict(attrs).get("class") == "ad"
        self.parts.append(" " if tag not in ("b", "i", "a", "em", "strong", "span") else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style") or (self.skip and tag == "div")
        self.parts.append(" " if tag not in ("b", "i", "a", "em", "strong", "span") else "")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_pages_against_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in queries.op8_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = _Articles()
        p.feed(r["html"])
        p.close()
        assert got[r["page_id"]] == " ".join("".join(p.parts).split()), r["page_id"]


def test_extract_of_repeated_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "u", page(f"<p>{LONG}</p>"), "x")] * 3 + [(2, None, None, None)], "page_id long, url string, html string, core string")
    out = htmltext.extract(rows).collect()
    assert [r["text"] for r in out] == [LONG.strip()] * 3 + [""] and [r["core"] for r in out] == ["x"] * 3 + [None]
    with pytest.raises(ValueError):
        htmltext.extract(rows.withColumn("text", F.lit(1)))


def test_pages_query(spark):
    found = queries.op8_main_text(spark, SF).toPandas()
    assert len(found) == 50 and (found.text.str.len() == found.n_chars).all() and (found.n_chars > 0).all()
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(MODEL))


def test_pieces_equal_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(1)
    texts = ["", " ", "  a  b   ", "x" * 500, "tab\there\n\n", "naïve — “q” 😀 中文", " " * 40 + "y" + " " * 17, "a\u0000b"]
    texts += ["".join(r.choice("abcdeinorst  \nABé190.,-_/()中") for _ in range(r.randint(1, 40))) for _ in range(2000)]
    assert model.encode(texts) == library.encode(texts)
    assert [model.decode(i) for i in model.encode(texts)] == texts


def test_shared_prefixes_give_what_single_words_give(model):
    words = ["▁the", "▁then", "▁thenar", "▁them", "▁th", "▁xyzé", "▁x"]
    assert dict(model._walk_merges(sorted(words))) == {w: dict(model._walk_merges([w]))[w] for w in words}


def test_unigram_scores_are_the_best(model):
    toy = pieces.PieceModel(pieces.read_model(MODEL))
    toy.scores, toy.longest, toy.low = {"a": -2.0, "b": -2.0, "ab": -3.0, "aba": -3.5, "ba": -2.5}, 3, -20.0
    toy.ids = {p: i for i, p in enumerate(toy.scores)}

    def best(word):
        if not word:
            return 0.0
        return max(toy.scores.get(word[:k], -20.0 if k == 1 else -1e9) + best(word[k:]) for k in range(1, len(word) + 1))

    number = {i: p for p, i in toy.ids.items()}
    for word, ids in toy._walk_scores(sorted({"ab", "aba", "abab", "bababa", "b"})):
        assert abs(sum(toy.scores[number[i]] for i in ids) - best(word)) < 1e-9


def test_encoding_drops_what_it_needs_no_more(spark, model):
    """A text's words go when its ids are there, and tables of powers that an earlier stage left go before the first text."""
    alive = []

    class Words(list):
        def __del__(self):
            alive.append(-1)

        def __iter__(self):
            alive.append(1)
            return super().__iter__()

    toy = pieces.PieceModel.__new__(pieces.PieceModel)
    toy.__dict__ = model.__dict__ | {"words": {}, "marked": lambda text: Words(pieces.PieceModel.marked(model, text))}
    assert toy.encode(["a b", "c", "a"]) == [model.encode([t])[0] for t in ("a b", "c", "a")]
    assert alive[-6:] == [1, -1] * 3  # the first three are learnt from before

    ByteHash(np.zeros(9, dtype=np.uint8))
    taken = []
    df = documents(spark, ["a b"])
    df.mapInArrow = lambda run, schema: taken.append(run)
    pieces.encode_and_decode(df, pieces.read_model(MODEL))
    batch = pa.RecordBatch.from_pydict({"doc_id": [0], "text": ["a b"]})
    assert common._powers and next(taken[0](iter([batch]))).column("decoded").to_pylist() == ["a b"] and not common._powers


def test_pieces_query_and_edges(spark):
    df = documents(spark, [None, "", "a word " * 20_000, "x"])
    proto = pieces.read_model(MODEL)
    out = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df, proto), proto).collect()}
    assert out[0]["ids"] is None and out[0]["decoded"] is None and out[1]["ids"] == [] and out[2]["decoded"] == "a word " * 20_000
    assert pieces.encode(df.where("false"), proto).count() == 0
    found = queries.op9_pieces(spark, SF).toPandas()
    assert len(found) == 200 and found.round_trip.all()


# WARC


def test_derivatives_link_to_their_source():
    headers, block = warc.response(7, "http://a.example/x/", page("<p>Hello <a href='../y'>link</a></p>", "<meta name=k content=v>"))
    parsed = list(warc.records(warc.record(headers, block)))
    assert parsed == [(headers, block)]
    (meta, body), (conversion, text) = warc.derivatives(headers, block)
    meta, conversion, names = dict(meta), dict(conversion), dict(headers)
    assert meta["WARC-Refers-To"] == conversion["WARC-Refers-To"] == names["WARC-Record-ID"]
    envelope = json.loads(body)["Envelope"]
    assert envelope["WARC-Header-Metadata"] == names
    http = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["HTML-Metadata"]["Links"] == [{"path": "A@/href", "url": "http://a.example/y"}] and http["HTML-Metadata"]["Head"]["Title"] == "T"
    assert http["Entity-Digest"] == names["WARC-Payload-Digest"] and text == b"Hello link"
    import base64

    assert conversion["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(text).digest()).decode()


def test_warc_files_round_trip(spark, tmp_path):
    some = [warc.response(i, f"http://x/{i}", "é" * i) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(*r)) for r in some))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.record(*r) for r in some))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["block"]) for r in rows) == sorted(b for _, b in some * 2) and {r["type"] for r in rows} == {"response"}
    derived = warc.derive(spark.createDataFrame([(1, None, None), (2, "http://x", "<p>t</p>")], "page_id long, url string, html string"))
    warc.write(derived, str(tmp_path / "out"))
    data = b"".join(bytes(r["member"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    found = list(warc.records(data))
    assert len(found) == 4 and sorted(dict(h)["WARC-Type"] for h, _ in found) == ["conversion"] * 2 + ["metadata"] * 2
    assert {r["block"] for r in derived.collect() if r["record_type"] == "conversion"} == {"", "t"}


def test_derivatives_of_responses_of_files(spark, tmp_path):
    page_ = b"<html><head><title>T</title></head><body><p>Seen</p></body></html>"
    block = b"HTTP/1.0 404 Not Found\r\nContent-Type: text/html\r\nX-Own: 1\r\n\r\n" + page_
    full = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-02-02T02:02:02Z", "WARC-Target-URI": "http://x/é", "WARC-Payload-Digest": "sha1:GIVEN", "X-Note": 'a "b"'}
    bare = {"warc-type": "response", "warc-record-id": "<urn:uuid:2>", "warc-target-uri": "http://y/"}
    other = {"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:3>"}
    (tmp_path / "a.warc").write_bytes(b"".join(warc.record(list(h.items()), block) for h in (full, bare, other)))
    derived = warc.derive(warc.read(spark, str(tmp_path / "a.warc")))
    rows = {(r["key"], r["record_type"]): r for r in derived.collect()}
    assert set(rows) == {(f"<urn:uuid:{i}>", k) for i in (1, 2) for k in ("metadata", "conversion")}
    one, two = rows["<urn:uuid:1>", "conversion"], rows["<urn:uuid:2>", "conversion"]
    assert one["block"] == two["block"] == "Seen" and (one["date"], one["target_uri"], two["target_uri"]) == ("2020-02-02T02:02:02Z", "http://x/é", "http://y/")
    assert one["source_payload_digest"] == "sha1:GIVEN" and two["source_payload_digest"] == warc.digest(page_) and two["source_block_digest"] == warc.digest(block)
    http = json.loads(rows["<urn:uuid:1>", "metadata"]["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Response-Message"] == "HTTP/1.0 404 Not Found" and http["Headers"]["X-Own"] == "1"
    warc.write(derived, str(tmp_path / "out"))
    found = {(h["WARC-Refers-To"], h["WARC-Type"]): h for r in spark.read.parquet(str(tmp_path / "out")).collect() for x, _ in warc.records(bytes(r["member"])) for h in [dict(x)]}
    assert {k: (h["WARC-Source-Payload-Digest"], h["WARC-Source-Block-Digest"]) for k, h in found.items()} == {k: (r["source_payload_digest"], r["source_block_digest"]) for k, r in rows.items()}
    pairs = [[x["name"], x["value"]] for x in one["source_headers"]]
    assert json.loads(found["<urn:uuid:1>", "conversion"]["WARC-Source-Headers"]) == pairs and dict(pairs)["X-Note"] == 'a "b"'


def test_repeated_headers_and_encoded_payloads(spark, tmp_path):
    import zlib

    text = b"<title>T</title><p>Seen</p>" * 50
    chunks = lambda b: b"".join(b"%x;x=1\r\n%s\r\n" % (len(b[i : i + 100]), b[i : i + 100]) for i in range(0, len(b), 100)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    cases = [
        ([], text), ([("Transfer-Encoding", "chunked")], chunks(text)), ([("content-encoding", "gzip")], gzip.compress(text)), ([("Content-Encoding", "deflate")], zlib.compress(text)),
        ([("Content-Encoding", "deflate")], raw.compress(text) + raw.flush()), ([("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], chunks(gzip.compress(text))), ([("Content-Encoding", "gzip")], text),
    ]
    members = []
    for k, (extra, payload) in enumerate(cases):
        http = "".join(f"{n}: {v}\r\n" for n, v in [("Content-Type", "text/html; charset=utf-8; x=y"), ("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), *extra])
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>")]
        members.append(warc.record(headers, b"HTTP/1.1 200 OK\r\n" + http.encode() + b"\r\n" + payload))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(members[:3])) + b"".join(map(gzip.compress, members[3:])))
    rows = warc.derive(warc.read(spark, str(tmp_path / "a.warc.gz"))).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert [x["value"] for x in r["source_headers"] if x["name"] == "WARC-Concurrent-To"] == ["<a>", "<b>"]
        if r["record_type"] == "metadata":
            http = json.loads(r["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert http["Headers"]["Set-Cookie"] == ["a=1", "b=2"] and http["HTML-Metadata"]["Head"]["Title"] == "T"
        else:
            assert r["block"] == "\n".join(["Seen"] * 50)


class _Page(HTMLParser):
    """Title, links and visible words of a page, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at, self.title, self.links, self.words = [], "", [], []

    def handle_starttag(self, tag, attrs):
        if tag not in htmltext.VOID:
            self.at.append(tag)
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])
        self.words.append(" " if tag in htmltext.BLOCK else "")

    def handle_endtag(self, tag):
        while tag in self.at and self.at.pop() != tag:
            pass
        self.words.append(" " if tag in htmltext.BLOCK else "")

    def handle_data(self, data):
        if "title" in self.at:
            self.title += data
        if not {"head", "script", "style"} & set(self.at):
            self.words.append(data)


def test_warc_query_against_brute_force(spark):
    import base64
    from urllib.parse import urljoin

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    found = {(r["page_id"], r["record_type"]): r for r in queries.op10_warc(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == 2 * len(pages)
    for r in pages:
        p = _Page()
        p.feed(r["html"])
        p.close()
        meta, text = found[r["page_id"], "metadata"], found[r["page_id"], "conversion"]
        assert meta["refers_to"] == text["refers_to"] and meta["target_uri"] == text["target_uri"] == r["url"] and meta["record_id"] != text["record_id"]
        for x in (meta, text):
            assert x["content_length"] == len(x["block"].encode()) and x["block_digest"] == sha(x["block"].encode()) and x["source_payload_digest"] == sha(r["html"].encode())
        html = json.loads(meta["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert html["Head"]["Title"] == " ".join(p.title.split())
        assert [x["url"] for x in html["Links"] if x["path"] == "A@/href"] == [urljoin(r["url"], x) for x in p.links]
        assert text["block"].split() == "".join(p.words).split()


def test_warc_query(spark):
    found = queries.op10_warc(spark, SF).toPandas()
    assert len(found) == 100 and found.record_id.nunique() == 100 and found.groupby("page_id").refers_to.nunique().eq(1).all()


# neighbours


def test_footrule_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(20):
        p, n = 9, 4
        q, rows = r.permutation(p)[:n], np.array([r.permutation(p)[:n] for _ in range(5)])
        place = lambda o, x: list(o).index(x) if x in o else n
        want = [sum(abs(place(q, x) - place(o, x)) for x in range(p)) for o in rows]
        assert list(ann.footrule(q, rows, p)) == want


def test_neighbours_recall(spark):
    found = queries.op1_neighbours(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(e.embedding.tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = {v: i for i, v in enumerate(e.vec_id)}
    hit = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[at[q]]
        s[at[q]] = -9
        hit += len(set(e.vec_id.to_numpy()[np.argsort(-s)[:5]]) & set(g.vec_id))
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5] and all(abs(s[at[v]] - c) < 1e-12 for v, c in zip(g.vec_id, g.score))
    assert hit / len(found) >= 0.9


def test_neighbours_are_ranked_by_footrule(spark, monkeypatch):
    """The query's candidates come by footrule: turned upside down, it leaves the rerank to the far ones."""
    best = {(r["query_id"], r["rank"]): r["score"] for r in queries.op1_neighbours(spark, SF).collect()}
    true = ann.footrule
    monkeypatch.setattr(ann, "footrule", lambda query, posted, pivots: -true(query, posted, pivots))
    turned = {(r["query_id"], r["rank"]): r["score"] for r in queries.op1_neighbours(spark, SF).collect()}
    assert len(best) == len(turned) and sum(best.values()) > sum(turned.values())


def test_nearer_against_sorting():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 50):
        steps = r.integers(0, 9, n)
        for count in (1, 5, 49, 60):
            assert list(np.flatnonzero(ann.nearer(steps, count))) == sorted(np.argsort(steps, kind="stable")[:count])


def test_neighbours_of_repeated_keys(spark):
    """A key that fills a file takes one place only; the other keys are still found."""
    near, far = [1.0, 0.1], [0.8, 0.6]
    df = spark.createDataFrame([(0, [1.0, 0.0]), *[(1, near)] * 300, (2, far), (3, far), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = [(r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert out == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id").isin(0, 4, 5)).collect())
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_pivots_are_apart():
    r = np.random.default_rng(3)
    v = r.standard_normal((1200, 16))
    v[:400] = v[0] + 0.1 * r.standard_normal((400, 16))
    chosen = ann.choose_pivots(v, 64)
    group = chosen @ (v[:400].mean(axis=0) / np.linalg.norm(v[:400].mean(axis=0)))
    assert len(chosen) == 64 and (group > 0.9).sum() <= 2
    assert len(ann.choose_pivots(np.array([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [3.0, 3.0]]), 256)) == 3


def test_neighbours_recall_where_near_copies_hold_a_third(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(0)
    n = 24_000
    v = r.standard_normal((n, 64)).astype(np.float32)
    v[: n // 3] = v[0] + 0.1 * r.standard_normal((n // 3, 64))
    key = r.permutation(n)
    pq.write_table(pa.table({"vec_id": key, "embedding": pa.array(list(v), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    asked = np.r_[np.arange(0, n // 3, 400), np.arange(n // 3, n, 200)]
    df = spark.read.parquet(str(tmp_path / "e.parquet"))
    found = ann.search(df, F.col("vec_id").isin([int(x) for x in key[asked]])).toPandas().groupby("query_id")["vec_id"].agg(set)
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = []
    for q in asked:
        s = x @ x[q]
        s[q] = -9
        hits.append(len(set(key[np.argsort(-s)[:5]]) & found[key[q]]) / 5)
    inside = asked < n // 3
    assert np.mean(np.array(hits)[inside]) == 1 and np.mean(np.array(hits)[~inside]) >= 0.95


def test_neighbours_recall_of_many_vectors(spark, tmp_path):
    """Ids divisible by 100 against all of 50,000 vectors in ten loose clusters; exact copies tie to the smaller id."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(5)
    n = 50_000
    v = (0.5 * r.standard_normal((10, 64))[r.integers(0, 10, n)] + r.standard_normal((n, 64))).astype(np.float32)
    v[1::500] = v[0::500]
    v[2::500] = v[0::500]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(v), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    found = ann.search(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].agg(list)
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    asked = np.arange(0, n, 100)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    true = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(t) & set(found[q])) / 5 for q, t in zip(asked, true)]) >= 0.9
    assert all(found[q][:2] == [q + 1, q + 2] for q in range(0, n, 500))
