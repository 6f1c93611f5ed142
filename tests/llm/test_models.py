import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.llm import ctw, langmix, quality, queries
from tests.llm.test_dedup import words

DOCS = "doc_id long, text string"


def part(i, of=5):
    return zlib.crc32(("" if i is None else str(i)).encode()) % of


# quality


def test_quality_separates_held_out_rows(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    docs, labels = [], []
    for k in range(600):
        body = [word() for _ in range(rnd.randint(20, 80))]
        good = rnd.random() < 0.8
        docs.append((k, " ".join(body).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in body)))
        if rnd.random() < 0.6:
            labels.append((k, int(good)))
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d, l)
    truth = {k: t.endswith(".") for k, t in docs}
    found = {r.doc_id: r.score for r in quality.score(d, model).collect() if part(r.doc_id) == 0}
    assert all((s >= 0.3) == truth[k] for k, s in found.items()) and len(found) > 50


def test_quality_does_not_see_held_out_labels(spark):
    docs = spark.createDataFrame([(k, f"word{k} and some more text of this document {k % 7}" + "!" * (k % 3)) for k in range(100)], DOCS)
    labels = [(k, int(k % 3 == 0)) for k in range(100)]
    flipped = [(k, 1 - q if part(k) == 0 else q) for k, q in labels]
    models = [quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped)]
    assert np.allclose(models[0].weights, models[1].weights)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "a" * 100_000), (None, "x"), (4, "a b")], DOCS).withColumn("score", F.lit("old")).withColumn("cell", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (99, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.filter("false"), model).count() == 0
    empty = quality.fit(docs, labels.filter("false"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_quality_risk_falls_to_the_minimum(spark, sf):
    """The gradient of the unbiased risk is 0 where fitting stops, or the non-negative part is at its border."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, ridge=1e-4, steps=40)
    marked = {r.doc_id: r.quality for r in labels.collect() if part(r.doc_id) != 0}
    rows = [(r.doc_id, r.text) for r in docs.collect() if part(r.doc_id) != 0]
    grid = quality.cells([t.encode() for _, t in rows], np.array(model.odds))
    at = quality._columns([g.tobytes() for g in grid])
    x = np.zeros((len(rows), quality.WIDTH))
    np.put_along_axis(x, at, 1.0, axis=1)
    p = np.array([marked.get(i) == 1 for i, _ in rows])
    w = np.array(model.weights)
    g = x @ w
    gradient = (x / (1 + np.exp(-g))[:, None]).mean(axis=0) - model.prior * x[p].mean(axis=0) + 1e-4 * w
    border = np.logaddexp(0, g).mean() - model.prior * np.logaddexp(0, g[p]).mean() <= -2.0 / np.sqrt(p.sum())
    assert np.abs(gradient).max() < 0.02 or border


# context trees


def brute_tree(texts, depth):
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        s = bytes(depth) + b" ".join(words(t)) + b"\0"
        for j in range(depth, len(s)):
            for k in range(8):
                for d in range(depth + 1):
                    counts[s[j - d : j], 1 << k | s[j] >> 8 - k][s[j] >> 7 - k & 1] += 1
    own, kids = {}, defaultdict(float)
    for d in range(depth, -1, -1):
        for (c, node), (a, b) in list(counts.items()):
            if len(c) == d:
                pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                pw = pe if d == depth else np.logaddexp(pe, kids[c, node]) - math.log(2)
                own[c, node] = 1.0 if d == depth else math.exp(pe - math.log(2) - pw)
                if d:
                    kids[c[1:], node] += pw
    return dict(counts), own


def brute_score(text, counts, own, depth):
    s, total = bytes(depth) + b" ".join(words(text)) + b"\0", 0.0
    for j in range(depth, len(s)):
        for k in range(8):
            guess = 0.5
            for d in range(depth, -1, -1):
                key = s[j - d : j], 1 << k | s[j] >> 8 - k
                if key in counts:
                    a, b = counts[key]
                    guess = own[key] * (b + 0.5) / (a + b + 1) + (1 - own[key]) * guess
                else:
                    guess = 0.5
            total += math.log10(guess if s[j] >> 7 - k & 1 else 1 - guess)
    return total


@pytest.mark.parametrize("sent", [16, 1 << 20])
def test_scores_equal_brute_force(spark, monkeypatch, sent):
    """With few entries sent to the tasks, most grams and words are looked up by joins."""
    monkeypatch.setattr(ctw, "SENT", sent)
    rnd = random.Random(8)
    rows = [(k, " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 40)))) for k in range(40)]
    rows += [(100, None), (101, " A  b\t\nC "), (102, "b" * 20_000), (3, rows[3][1]), (None, "ab"), (103, "\x00 zero")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lp", F.lit("clash")).withColumn("row", F.lit(1))
    train = [t for i, t in rows if part(i) != 1]
    counts, own = brute_tree(train, ctw.DEPTH)
    known = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(known.values()), len(known)
    found = sorted(ctw.score(docs).collect(), key=lambda r: (str(r.doc_id), r.score))
    wanted = []
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        wanted.append((i, part(i) == 1, len(tokens), sum(known[w] > 0 for w in tokens), n, base, brute_score(t, counts, own, ctw.DEPTH)))
    wanted.sort(key=lambda r: (str(r[0]), r[-1]))
    assert len(found) == len(wanted)
    for r, w in zip(found, wanted, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9) and r.score == pytest.approx(w[6], rel=1e-9)


def test_scores_of_nothing(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(20) if part(k) == 1], DOCS)
    assert ctw.score(docs.filter("false")).count() == 0
    assert {round(r.bits_per_byte, 6) for r in ctw.score(docs).collect()} == {8.0}


def test_lookup_finds_all_and_only():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(-(2**63), 2**63, 5000))
    at = ctw.Lookup(keys).find(np.concatenate([keys, keys + 1]))
    assert (at[: len(keys)] == np.arange(len(keys))).all()
    other = np.isin(keys + 1, keys)
    assert ((at[len(keys) :] >= 0) == other).all()
    assert (ctw.Lookup(keys[:0]).find(keys) == -1).all()


def test_kt_is_exact():
    a, b = np.array([0, 1, 3, 0, 100, 12345.0]), np.array([0, 0, 2, 7, 1, 54321.0])
    exact = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b, strict=True)]
    assert np.allclose(ctw.kt(a, b), exact, rtol=1e-12, atol=1e-12)
    assert ctw.kt(np.array([0.0]), np.array([0.0]))[0] == pytest.approx(0, abs=1e-12)


# languages


def test_language_of_held_out_rows(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (part(r.doc_id) == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_lang = defaultdict(list)
    for r in docs.filter("n_chars > 400").collect():
        by_lang[r.lang].append(" ".join(re.findall(r"[^\W\d_]+", r.text)[:60]))
    model = langmix.fit(docs)
    mixed = by_lang["en"][0] + " " + by_lang["de"][0] + " " + by_lang["en"][1]
    rows = [(1, None), (2, ""), (3, "123 !! ###"), (4, mixed), (5, "«»"), (None, by_lang["fr"][0]), (6, by_lang["es"][0] * 300), (7, "Ω")]
    found = {r.doc_id: r for r in langmix.identify(spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("xx")), model).collect()}
    assert {k for k, r in found.items() if r.lang_pred == "und"} == {1, 2, 3, 5}
    assert all(r.score == 0 for r in found.values() if r.lang_pred == "und")
    assert set(found[4].langs) == {"en", "de"} and found[4].lang_pred == "en"
    assert found[4].shares[0] == pytest.approx(2 / 3, abs=0.12)
    assert (found[None].lang_pred, found[6].lang_pred) == ("fr", "es") and found[7].lang_pred in model.langs
    assert langmix.identify(docs.filter("false"), model).count() == 0
    nothing = langmix.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langmix.identify(docs, nothing).select("lang_pred").distinct().collect()} == {"und"}


def test_inference_equals_a_plain_loop():
    rnd = np.random.default_rng(3)
    counts = {x: rnd.integers(0, 50, langmix.BUCKETS).astype(float) for x in ("a", "b", "c")}
    model = langmix.LanguageModel(counts)
    text = b"some words of a text that are split into parts here and there"
    buckets, first, _ = langmix._trigrams([text])
    like = np.add.reduceat(model.logs[buckets], first, axis=0).astype(float)
    theta = np.full(3, 1 / 3)
    for _ in range(langmix.ROUNDS):
        r = np.exp(like - like.max(axis=1, keepdims=True)) * theta
        theta = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    value, found = model._maximise(like, np.array([0]), np.array([len(like)]), np.ones((1, 3), bool))
    assert np.allclose(found[0], theta) and value[0] == pytest.approx(np.log((np.exp(like) * theta).sum(axis=1)).sum())
    assert pa.array([1]) is not None


def test_the_prior_comes_from_positives_and_all_texts(spark, sf):
    """Mixtures of two scores with a known share, and the table, whose labels of 0 are not read."""
    rnd = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.9):
        good, bad = (np.clip(rnd.normal(m, 60, 200_000).astype(int), 0, 799) for m in (500, 250))
        n = int(share * 200_000)
        u, p = np.bincount(np.append(good[:n], bad[: 200_000 - n]), minlength=800), np.bincount(rnd.permutation(good)[:20_000], minlength=800)
        assert abs(quality.best_bin(u, p) - share) < 0.03
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one, other = (quality.fit(docs, x) for x in (labels, labels.filter("quality = 1")))
    assert np.allclose(one.weights, other.weights) and one.prior == other.prior


def test_likeness_reads_trigrams():
    texts = [b"the cat sat on the mat and the dog", b"zqx zqx zqx zqx zqx zqx zqx"]
    grams, first = quality.trigram_counts(texts)
    assert list(np.diff(first)) == [len(t) for t in texts]
    count = lambda k: np.bincount(grams[first[k] : first[k + 1]], minlength=quality.BUCKETS) * 10_000
    odds = quality.log_odds(count(0) + count(1), count(0))
    liked = quality.measures(texts, odds)[:, -1]
    assert liked[0] > 0.1 and liked[1] < -1


def test_likelihoods_by_runs_of_words(monkeypatch):
    """The runs in which words are looked up change nothing, down to one word at a time."""
    rnd = np.random.default_rng(3)
    model = langmix.LanguageModel({x: rnd.integers(0, 50, langmix.BUCKETS).astype(float) for x in ("a", "b", "c")})
    buckets, words, _ = langmix._trigrams([b"one word and another, then some more", b"", b"x"])
    whole = np.add.reduceat(model.logs[buckets], words, axis=0)
    for cells in (1, 12, 40, 1 << 24):
        monkeypatch.setattr(langmix, "CELLS", cells)
        assert np.array_equal(model._likelihoods(buckets, words), whole.astype(np.float64))


def test_more_languages_have_fewer_buckets(spark):
    """300 languages, beyond those with all buckets: each text is still found by its own words."""
    assert [langmix.bucket_bits(n) for n in (0, 1, 256, 257, 512, 513, 65536)] == [16, 16, 16, 15, 15, 14, 8]
    with pytest.raises(ValueError, match="languages"):
        langmix.bucket_bits(65537)
    rnd = np.random.default_rng(4)
    own = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 24)) for _ in range(300)]
    rows = [(k, f"{w} {w} {w}", f"l{k:03d}") for k, w in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langmix.fit(docs)
    learned = {r.lang for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).collect()}
    few = langmix.LanguageModel({x: np.ones(1 << 10) for x in "ab"})
    assert len(model.langs) == len(learned) and few.shift == 6
    wide = spark.createDataFrame([(5 * k + j, f"{w} {w} {w}", f"l{k:03d}") for k, w in enumerate(own) for j in range(5)], docs.schema)
    model = langmix.fit(wide)
    assert model.logs.shape == (1 << 15, len(model.langs)) and len(model.langs) > 256
    found = {r.doc_id: r.lang_pred for r in langmix.identify(docs, model).collect()}
    assert all(found[k] == lang for k, _, lang in rows if lang in model.langs)


# --- the quality query against plain loops


def _plain_trigrams(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text) + b"  "
    return [((((b[i] << 16) | (b[i + 1] << 8) | b[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 20 for i in range(len(text))]


def _plain_measures(text, odds):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return [0.0] * 13
    n, size = len(words), len(text) + 1
    marks, symbols = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*+/<=>@[\\]^_`{}~"
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    shingles = {tuple(words[i : i + 5]) for i in range(max(n - 4, 1))}
    return [
        sum(c in symbols for c in text) / size,
        sum(c in marks for c in text) / size,
        sum(a == b and b in marks for a, b in zip(text, text[1:], strict=False)) / size,
        sum(65 <= c <= 90 for c in text) / max(letters, 1),
        sum(48 <= c <= 57 for c in text) / size,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(words)) / n,
        len(shingles) / max(n - 4, 1),
        math.log10(n),
        sum(map(len, words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(odds[g] for g in _plain_trigrams(text)) / max(len(text), 1),
    ]


def _plain_row(text, odds):
    """Places of the ones of a text, the constant last."""
    out, before = [], 0
    for value, edges in zip(_plain_measures(text, odds), quality.EDGES.values(), strict=True):
        out.append(before + sum(value >= e for e in edges))
        before += len(edges) + 1
    return [*out, before]


def test_quality_query_equals_plain_loops(spark, sf):
    """Trigram odds, measures, cells, prior and scores of every row from plain loops; the weights by the gradient of the plain risk."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1 and part(r.doc_id) != 0}
    source, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(source, labels)
    learn = [d for d in docs if part(d) != 0]
    u, p = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for d in learn:
        for g in _plain_trigrams(docs[d]):
            u[g] += 1
            p[g] += d in good
    total_u, total_p = sum(u), sum(p)
    base = [(x + 0.5) / (total_u + 0.5 * quality.BUCKETS) for x in u]
    odds = [math.log((y + quality.STRENGTH * b) / (total_p + quality.STRENGTH) / b) for y, b in zip(p, base, strict=True)]
    assert max(abs(a - b) for a, b in zip(odds, model.odds, strict=True)) < 1e-9

    rows = {d: _plain_row(t, odds) for d, t in docs.items()}
    plain = {d: 1 / (1 + math.exp(-sum(model.weights[k] for k in row))) for d, row in rows.items()}
    found = {r.doc_id: r for r in queries.op3_quality_classifier(spark, sf).collect()}
    assert found.keys() == docs.keys()
    off = [d for d, r in found.items() if abs(r.score - plain[d]) > 1e-6]  # a measure on an edge may fall to either side
    assert len(off) <= len(docs) // 200
    assert all(r.held_out == (part(d) == 0) and r.predicted == int(r.score >= 0.3) for d, r in found.items())

    n_u, n_p, ridge = len(learn), len(good), 0.04 / math.sqrt(len(good))
    gradient = [ridge * w for w in model.weights]
    for d in learn:
        for k in rows[d]:
            gradient[k] += plain[d] / n_u - (model.prior / n_p if d in good else 0.0)
    assert max(map(abs, gradient)) < 2e-3

    first = quality.fit(source, labels, prior=0.5)
    bins = {}
    for d in learn:
        at = max(-400, min(400, math.floor(20 * sum(first.weights[k] for k in rows[d]))))
        x = bins.setdefault(at, [0, 0])
        x[0] += 1
        x[1] += d in good
    slack = math.sqrt(math.log(4 / 0.1) / 2 / n_u) + math.sqrt(math.log(4 / 0.1) / 2 / n_p)
    q_u = q_p = 0.0
    best = None
    for at in sorted(bins, reverse=True):
        q_u, q_p = q_u + bins[at][0] / n_u, q_p + bins[at][1] / n_p
        if q_p > 0 and (best is None or q_u / q_p + 1.01 * slack / q_p < best[0]):
            best = (q_u / q_p + 1.01 * slack / q_p, min(1.0, q_u / q_p))
    assert abs(min(best[1], 0.99) - model.prior) < 1e-6
