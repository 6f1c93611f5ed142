import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import components, exact_dedup, queries, setsketch, text
from tests.compare import same_rows

DOCS = "doc_id long, text string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs, percent):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_exact_dedup_equals_sql(spark, duck, sf):
    same_rows(queries.op1_exact_dedup(spark, sf), duck, queries.SQL["op1_exact_dedup"])


def test_directory_doubles_until_buckets_fit():
    counts = Counter(random.Random(3).choices(range(16), k=1000)) + Counter({5: 2000})
    depth, slots = exact_dedup.directory(counts, 150, 4)
    assert len(slots) == 1 << depth and sorted(s for s, _, _ in slots) == list(range(1 << depth))
    held = Counter()
    for slot, bucket, local in slots:
        held[bucket] += sum(n for p, n in counts.items() if p >> (4 - depth) == slot)
        assert local <= depth
    overfull = [b for b, n in held.items() if n > 150]
    assert all(local == 4 for _, b, local in slots if b in overfull)
    assert exact_dedup.directory({}, 10, 4) == (0, [(0, 0, 0)])


@pytest.mark.parametrize("capacity", [1, 1000])
def test_exact_dedup_edges(spark, capacity):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (8, "x" * 300_000), (None, "a b"), (9, "a b ")], DOCS)
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs.withColumn("key", F.lit(1)).withColumn("digest", F.lit("x")), capacity).collect())
    assert found == Counter([(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 3, False), (8, 8, 3, True), (8, 8, 3, True), (9, 9, 1, True)])
    assert exact_dedup.exact_duplicates(docs.filter("false")).count() == 0


def three_keys(norm):
    """A hash with three values that differ in their first bits: all texts collide."""
    return F.shiftleft((F.length(norm) % 3).cast("long"), 62)


@pytest.mark.parametrize("capacity", [1, 2, 1000])
def test_colliding_texts_are_chained_and_told_apart(spark, capacity):
    rnd = random.Random(capacity)
    rows = [(k if k % 11 else None, "".join(rnd.choice("aAbB") for _ in range(rnd.randint(0, 4)))) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    groups = {}
    for d, t in rows:
        groups.setdefault(t.lower(), []).append(d)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    out = exact_dedup.exact_duplicates(docs, capacity, 4, three_keys).collect()
    wanted = Counter((d, keep[t.lower()], len(groups[t.lower()]), hashlib.sha256(t.lower().encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == wanted
    assert len({r.bucket for r in out}) == {1: 3, 2: 2, 1000: 1}[capacity] and max(r.chain for r in out) > 5  # chains are long, buckets as the directory says


def test_the_answer_goes_through_the_directory(spark):
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(200)], DOCS)
    rows, folder, pages = exact_dedup.build_index(docs, 5, 8)
    slots = {r.slot: r.bucket for r in folder.collect()}
    depth = (len(slots) - 1).bit_length()
    for r in pages.collect():
        assert slots[(r.key & (2**64 - 1)) >> (64 - depth)] == r.bucket
    assert max(Counter(r.bucket for r in pages.collect()).values()) <= 5 and pages.count() == 40
    assert rows.join(pages, ["bucket", "key"]).count() == 200


def test_word_and_shingle_keys_follow_the_definition():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB é\t\n\x0b\x1c x") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + ["", "   ", "one"]
    sets, first = text.shingle_sets([t.encode() for t in texts])
    keys, at = text.keyed_words([t.encode() for t in texts])
    by_word, by_set = {}, {}
    for t, a, b, i, j in zip(texts, first[:-1], first[1:], at[:-1], at[1:], strict=True):
        assert j - i == len(words(t)) and b - a == len(shingles(t))
        for w, k in zip(words(t), keys[i:j], strict=True):
            assert by_word.setdefault(w, k) == k
        assert by_set.setdefault(shingles(t), sets[a:b].tobytes()) == sets[a:b].tobytes()
    assert len(set(by_word.values())) == len(by_word)


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(2)
    a, b = (np.unique(rnd.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    a, b = np.concatenate([a, b[:300]]), b
    sketch = lambda s: setsketch.registers(s, np.array([0, len(s)]), 256)[0]
    assert (setsketch.merge(sketch(a), sketch(b)) == sketch(np.union1d(a, b))).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sketch(a) == sketch(b)).mean() - true) < 0.12
    n = lambda s: np.array([float(len(s))])
    more, less = np.array([(sketch(a) > sketch(b)).sum()]), np.array([(sketch(a) < sketch(b)).sum()])
    assert not setsketch.may_reach(more, less, 256, n(a), n(b), 85)[0]
    assert setsketch.may_reach(more, less, 256, n(a), n(b), int(100 * true))[0]


def near_copies(seed, groups=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 25)):
            copy = base[:]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    return [*docs, (1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "a b c d e"), (1007, "a b c d e " * 5000)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_near_components_equal_brute_force(spark, seed, percent):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, DOCS).withColumn("cid", F.lit("clash")).withColumn("n", F.lit(0))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_components(docs, percent).collect()}
    assert found == brute_components(rows, percent)


def test_residual_families_are_compared_exactly(spark, monkeypatch):
    """Small blocks, so that families take several block pairs."""
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 4)
    rows = near_copies(7, groups=3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_components(spark.createDataFrame(rows, DOCS), 85).collect()}
    assert found == brute_components(rows, 85)


def test_near_components_edges(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, None)], DOCS)
    assert rows_of(setsketch.near_components(docs)) == sorted([(3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (None, 2, 2, False), (None, 0, None, True)], key=str)
    assert setsketch.near_components(docs.filter("false")).count() == 0


def test_a_near_copy_without_an_id_is_linked(spark):
    base = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(5, base), (None, base + " more"), (6, "other words that are not alike at all"), (None, "x " + " ".join(f"v{k}" for k in range(90))), (None, " ".join(f"v{k}" for k in range(90)))], DOCS)
    found = rows_of(setsketch.near_components(docs, 85).select("doc_id", "component_id", "kept"))
    assert [r for r in found if r[0] is None].count((None, 5, False)) == 1 and (5, 5, True) in found and (6, 6, True) in found
    assert sorted(r[2] for r in found if r[0] is None and r[1] is None) == [False, True]


def test_boilerplate_is_not_compared_all_with_all(spark):
    """Texts with half of their words in common and no near copy: few share a bucket, and none that share none are compared."""
    rnd = random.Random(3)
    common = " ".join(f"c{k}" for k in range(80))
    m = setsketch.ROWS * setsketch.bands_for(85)
    sizes = {}
    for n in (300, 1200):
        rows = [(k, common + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80))) for k in range(n)]
        sets, first = text.shingle_sets([t.encode() for _, t in rows])
        keys = setsketch._band_keys(setsketch.registers(sets, first, m))
        sizes[n] = sum(c for column in keys.T for c in Counter(column.tolist()).values() if c > 1) / n
    assert sizes[300] < 3 and sizes[1200] < 8  # of 37 buckets of a text, those that others share


def test_near_components_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_minhash_near_dedup(spark, sf).collect()}
    assert found == brute_components(docs, 85)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (8, 7), (9, 8)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
