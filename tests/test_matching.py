"""Vector cells, linkage weights, names in texts, learned labels, payload schemas: against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from annalist import model
from annalist.functions import schema as Sc
from annalist.operators import evaluate as V
from annalist.operators import learned as Ln
from annalist.operators import linkage as Lk
from annalist.operators import mentions as M
from annalist.operators import resolve as R
from annalist.operators import vectors as Vx
from annalist.plans import matching
from annalist.sources import store as St
from tests.test_desk import event, frame

VECTORS = "id long, v array<float>"


def _same(a, b):
    return sorted((r.query, r.id, r.rank, round(r.similarity, 6)) for r in a.collect()) == sorted((r.query, r.id, r.rank, round(r.similarity, 6)) for r in b.collect())


def _groups(rnd, n, width=8, centres=12):
    middle = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(k, [x + rnd.gauss(0, 0.25) for x in middle[k % centres]]) for k in range(n)]


def test_cells_find_what_all_rows_have(spark):
    rnd = random.Random(1)
    rows = _groups(rnd, 900) + [(900 + k, [1.0] * 8) for k in range(300)]  # a vector that a quarter of the rows have
    bad = [(5_000, None), (5_001, [0.0] * 8), (5_002, [float("nan")] + [1.0] * 7), (5_003, [None] + [1.0] * 7), (5_004, [])]
    df = spark.createDataFrame(rows + bad, VECTORS)
    queries = df.filter("id % 100 = 0")
    whole = R.vector_topk(df.filter("id < 5000"), df.filter("id < 5000"), "id", "v", 10).join(queries.select(F.col("id").alias("query")), "query", "left_semi")
    index = Vx.fit_cells(df, "id", "v", cells=24)
    assert index.rows.sum() == 1_200
    assert _same(Vx.search(queries, df, index, "id", "v", 10, probes=3, exact=True, cell_rows=50), whole)
    some = Vx.search(queries, df, index, "id", "v", 10, probes=8, cell_rows=50)
    truth = {(r.query, r.id) for r in whole.collect()}
    got = some.collect()
    assert len({(r.query, r.id) for r in got} & truth) >= 0.9 * len(truth)
    by = {}
    for r in got:
        by.setdefault(r.query, [r.certain, set()])[1].add(r.id)
    assert all(found == {i for q, i in truth if q == query} for query, (certain, found) in by.items() if certain)
    assert Vx.fit_cells(df.filter("id >= 5000"), "id", "v") is None and Vx.search(queries, df, None, "id", "v").count() == 0
    assert Vx.search(queries.filter("false"), df, index, "id", "v").count() == 0


def test_recall_on_the_table(spark, sf):
    found = {(r.query, r.vec_id) for r in matching.vector_cells_near(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = {(r.query, r.vec_id) for r in R.vector_topk(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10).collect()}
    assert len(found & whole) >= 0.9 * len(whole)


def _plain_em(counted, sizes, rounds, smooth=0.5):
    m = [[(1 + k) ** 2 / sum((1 + j) ** 2 for j in range(s)) for k in range(s)] for s in sizes]
    u = [x[::-1] for x in m]
    p = 0.1
    for _ in range(rounds):
        new_m, new_u = [[smooth] * s for s in sizes], [[smooth] * s for s in sizes]
        same_total = total = 0.0
        for pattern, n in counted.items():
            a, b = p, 1 - p
            for k, level in enumerate(pattern):
                if level is not None:
                    a, b = a * m[k][level], b * u[k][level]
            g = a / (a + b)
            same_total, total = same_total + n * g, total + n
            for k, level in enumerate(pattern):
                if level is not None:
                    new_m[k][level] += n * g
                    new_u[k][level] += n * (1 - g)
        m = [[x / sum(row) for x in row] for row in new_m]
        u = [[x / sum(row) for x in row] for row in new_u]
        p = same_total / total
    return m, u, p


def test_weights_equal_plain_loops_and_tell_the_same_apart(spark):
    rnd = random.Random(5)
    pairs, truth = [], {}
    for k in range(2_000):
        same = rnd.random() < 0.2
        truth[k] = same
        draw = lambda hit, miss: hit if rnd.random() < (0.95 if same else 0.1) else miss  # noqa: E731, B023
        pairs.append((k, draw(2, rnd.choice([0, 1])), draw(1, 0), draw(1, 0), None if rnd.random() < 0.2 else draw(1, 0)))
    df = spark.createDataFrame(pairs, "id long, a int, b int, c int, d int")
    fields = ["a", "b", "c", "d"]
    counted = Lk.patterns(df, fields)
    weights = Lk.estimate(counted, fields, rounds=15, tolerance=0.0)
    m, u, p = _plain_em({tuple(r[f] for f in fields): r.n for r in counted.collect()}, [3, 2, 2, 2], 15)
    for got, want in ((weights.m, m), (weights.u, u)):
        assert all(abs(x - y) < 1e-9 for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
    assert abs(weights.share - p) < 1e-9 and all(b >= a - 1e-6 for a, b in zip(weights.history, weights.history[1:], strict=False))
    rows = Lk.probability(df, Lk.estimate(counted, fields)).collect()
    assert sum((r.confidence >= 0.5) == truth[r.id] for r in rows) >= 0.97 * len(rows)
    for r in rows[:50]:
        odds = Lk.estimate(counted, fields).log_odds(r.asDict()) if r.id < 3 else None
        assert odds is None or abs(1 / (1 + math.exp(-odds)) - r.confidence) < 1e-9
    assert Lk.estimate(counted.filter("false"), fields) is None and Lk.probability(df.filter("false"), None).count() == 0


def test_linked_customers_are_right(spark, sf):
    rows = matching.linked_customers(spark, sf).collect()
    matched = [r for r in rows if r.decision == "match"]
    assert sum(r.mention_id == r.entity_id for r in matched) >= 0.95 * len(matched) and len(matched) >= 0.5 * len(rows)


def test_one_entity_for_a_mention(spark):
    scored = spark.createDataFrame([("m1", "e1", 0.99), ("m1", "e2", 0.99), ("m2", "e3", 0.999), ("m2", "e3", 0.4), ("m3", "e9", 0.2), ("m3", "e8", 0.2), ("m4", "e1", 1.0)], "mention_id string, entity_id string, confidence double")
    got = {r.mention_id: (r.entity_id, r.decision) for r in Lk.best(scored).collect()}
    assert got == {"m1": ("e1", "none"), "m2": ("e3", "match"), "m3": ("e8", "none"), "m4": ("e1", "match")}


def _plain_places(text, names, whole, fold):
    looked = text.translate(M._FOLD) if fold else text
    out = []
    for name in {n.translate(M._FOLD) if fold else n for n in names if n}:
        at = looked.find(name)
        while at >= 0:
            b = at + len(name)
            if not whole or not ((at and text[at - 1].isalnum()) or (b < len(text) and text[b].isalnum())):
                out.append((name, at, b))
            at = looked.find(name, at + 1)
    return sorted(out)


def _plain_longest(places):
    out, end = [], 0
    for name, a, b in sorted(places, key=lambda p: (p[1], -p[2])):
        if a >= end:
            out.append((name, a, b))
            end = b
    return sorted(out)


@pytest.mark.parametrize(("whole", "fold"), [(True, True), (False, True), (True, False), (False, False)])
def test_names_equal_plain_search(spark, whole, fold):
    rnd = random.Random(3)
    names = ["Acme", "acme mining", "a a", "Mining Co", "é", "Über Öl", "😀 x", "co", "Co", "min", ""]
    words = ["Acme", "acme", "mining", "Mining", "Co", "a", "é", "Über", "Öl", "😀", "x", "min", "co", "-", "1"]
    texts = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) + rnd.choice(["", "s", "."])) for k in range(120)] + [(500, None), (501, ""), (502, "acme " * 30_000)]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("name", F.lit("clash"))
    given = spark.createDataFrame([(n,) for n in [*names, None, "Acme"]], "called string")
    for shares in (20_000_000, 12):  # in one pass and in several
        for longest in (False, True):
            found = {}
            for r in M.find_names(df, given, "id", "text", "called", whole, fold, longest, name_chars=shares).collect():
                found.setdefault(r.id, []).append((r.name, r.start, r.end))
            for k, t in texts:
                want = _plain_places(t or "", names, whole, fold)
                assert sorted(found.get(k, [])) == (_plain_longest(want) if longest else want)
    assert M.find_names(df, given.filter("false"), "id", "text", "called").count() == 0


def test_learned_labels_reach_the_target(spark, sf):
    docs, found = matching._languages(spark, sf)
    rows = found.join(docs.filter(Ln.held_out(F.col("doc_id"))).select("doc_id", "lang"), "doc_id")
    measures = {r.metric: r.value for r in V.evaluate(rows, "label", "lang").collect()}
    assert measures["macro f1"] >= 0.85 and rows.count() >= 20


def test_a_learned_classifier_over_many_classes(spark):
    """Six classes with words of their own among common ones; nulls, texts without words, unseen words; broadcast or not."""
    rnd = random.Random(4)
    classes = ["mine", "farm", "power", "transport", "border", "supply"]
    make = lambda c: " ".join(rnd.choice([f"{c}{rnd.choice('abcdefgh')}", f"{c}{rnd.choice('abcdefgh')}", "the", "and", "site"]) for _ in range(12))
    rows = [(k, make(classes[k % 6]), classes[k % 6]) for k in range(600)] + [(900, None, "mine"), (901, "", None), (902, "unseen", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    tokens = Ln.words_of(F.col("text"))
    taught = docs.filter(~Ln.held_out(F.col("doc_id")))
    labels, words = Ln.learn(taught, tokens, "label")
    kept = {r.doc_id for r in docs.filter(Ln.held_out(F.col("doc_id"))).collect()}
    said = [(r.label, r.text) for r in taught.collect() if r.label]
    n = {(c, w): sum((t or "").split().count(w) for k, t in said if k == c) for c in classes for w in {w for _, t in said for w in (t or "").split()}}
    total, v = {c: sum(x for (k, _), x in n.items() if k == c) for c in classes}, len({w for (_, w) in n})
    for most in (1_000_000, 0):
        found = {r.doc_id: (r.label, r.score) for r in Ln.predict(docs, tokens, "doc_id", labels, words, broadcast_words=most).collect()}
        assert len(found) == 603
        assert sum(found[k][0] == c for k, _, c in rows if k in kept and c and k < 600) >= 0.95 * len([k for k in kept if k < 600])
        for k, text, _ in rows[::37] + rows[-3:]:
            tokens_of = (text or "").split()
            plain = {c: math.log(sum(x == c for x, _ in said) / len(said)) + sum(math.log((n.get((c, w), 0) + 1) / (total[c] + v + 1)) for w in tokens_of) for c in classes}
            best = max(plain.values())
            assert abs(found[k][1] - best) < 1e-6 and abs(plain[found[k][0]] - best) < 1e-6
    empty = Ln.predict(docs, tokens, "doc_id", labels.filter("false"), words)
    assert empty.count() == 603 and empty.filter("label IS NOT NULL").count() == 0


def _plain_identity(merges):
    goal = {}
    for a, b in merges:
        goal[a] = min(b, goal.get(a, b))
    out = {}
    for a in goal:
        seen, x = [], a
        while x in goal and x not in seen:
            seen.append(x)
            x = goal[x]
        out[a] = x if x not in goal else min(seen[seen.index(x) :])
    return out


def test_identity_with_cycles_and_long_chains(spark):
    rnd = random.Random(6)
    long = [(k, k + 1) for k in range(300)]
    cycle = [(1_000 + k, 1_000 + (k + 1) % 37) for k in range(37)] + [(2_000, 1_005), (2_001, 2_000), (3_000, 3_000)]
    wild = [(rnd.randint(5_000, 5_060), rnd.randint(5_000, 5_060)) for _ in range(50)]
    merges = [*long, *cycle, *wild]
    rnd.shuffle(merges)
    df = spark.createDataFrame(merges, "entity_id long, merged_into long")
    assert {r.entity_id: r.canonical_id for r in R.canonical_ids(df).collect()} == _plain_identity(merges)
    assert R.canonical_ids(df.filter("false")).count() == 0
    when = "entity_id string, merged_into string, at int"
    merges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "b", 5), ("x", "y", 1), ("y", "x", 3)], when)
    splits = spark.createDataFrame([("a", "b", 3)], "entity_id string, split_from string, at int")
    at = lambda t: {r.entity_id: r.canonical_id for r in R.identity_at(merges, splits, F.lit(t)).collect()}
    assert at(0) == {} and at(1) == {"a": "b", "x": "y"} and at(2) == {"a": "c", "b": "c", "x": "y"}
    assert at(3) == {"b": "c", "x": "x", "y": "x"} and at(5) == {"a": "c", "b": "c", "x": "x", "y": "x"}


SCHEMA = {
    "type": "object",
    "required": ["stage", "site"],
    "additionalProperties": False,
    "properties": {
        "stage": {"type": "integer", "minimum": 1, "maximum": 13},
        "site": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"}, "it's": {"type": ["number", "null"]}}},
        "parts": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["n"], "properties": {"n": {"enum": [1, "two", None, [1, 2]]}}}},
        "open": {"const": True},
    },
}
CASES = [
    ({"stage": 4, "site": {"name": "Ab"}}, None),
    ({"stage": 4.0, "site": {"name": "Ab", "it's": 1.5}, "parts": [{"n": 1}, {"n": "two"}, {"n": None}], "open": True}, None),
    ({"stage": 4, "site": {"name": "Ab", "other": 1, "it's": None}, "parts": [{"n": [1, 2]}]}, None),
    ([1], "$: type is not object"),
    ({"stage": 4}, "$.site: missing"),
    ({"stage": 4.5, "site": {"name": "Ab"}}, "$.stage: type is not integer"),
    ({"stage": "4", "site": {"name": "Ab"}}, "$.stage: type is not integer"),
    ({"stage": None, "site": {"name": "Ab"}}, "$.stage: type is not integer"),
    ({"stage": 0, "site": {"name": "Ab"}}, "$.stage: below the minimum"),
    ({"stage": 14, "site": {"name": "Ab"}}, "$.stage: above the maximum"),
    ({"stage": 4, "site": {}}, "$.site.name: missing"),
    ({"stage": 4, "site": {"name": "A"}}, "$.site.name: too short"),
    ({"stage": 4, "site": {"name": "ab"}}, "$.site.name: does not match the pattern"),
    ({"stage": 4, "site": {"name": "Ab", "it's": "x"}}, "$.site.it's: type is not number or null"),
    ({"stage": 4, "site": {"name": "Ab"}, "zeta": 1, "extra": 1}, "$.extra: not a known name"),
    ({"stage": 4, "site": {"name": "Ab"}, "parts": []}, "$.parts: too few items"),
    ({"stage": 4, "site": {"name": "Ab"}, "parts": [{"n": 1}, {}]}, "$.parts[].n: missing"),
    ({"stage": 4, "site": {"name": "Ab"}, "parts": [{"n": 2}]}, "$.parts[].n: not one of the values"),
    ({"stage": 4, "site": {"name": "Ab"}, "parts": [{"n": 1}] * 4}, "$.parts: too many items"),
    ({"stage": 4, "site": {"name": "Ab"}, "open": False}, "$.open: not the constant"),
]


def test_payload_schemas(spark, tmp_path):
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in enumerate(CASES)] + [(100, None), (101, "{")], "k long, payload string")
    got = {r.k: r.v for r in rows.select("k", Sc.violation(F.col("payload"), SCHEMA).alias("v")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(CASES)} | {100: "$: no JSON", 101: "$: no JSON"}
    for wrong in ({"oneOf": []}, {"type": "text"}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            Sc.violation(F.col("payload"), wrong)
    assert {r.v for r in rows.select(Sc.violation(F.col("payload"), True).alias("v")).collect()} == {None, "$: no JSON"}
    store = St.EventStore(spark, str(tmp_path), schemas={"SignalScored": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}})
    assert store.append_events(frame(spark, event(1), event(2, payload='{"n": "x"}'), event(3, event_type="DealIdentified", payload="{}"))) == 1
    assert [(r.id, r.reason_code) for r in store.quarantine.read().collect()] == [("e2", "schema $.n: type is not integer")]
    assert model.QUARANTINE and store.read().count() == 2


def test_claims_have_a_subject_and_an_object(spark):
    from annalist.operators import agents as A

    names = spark.createDataFrame([("Acme",), ("Acme Mining",), ("Big Dam",), ("Zambezi Rail",)], "name string")
    texts = {
        1: "Rumour has it. Acme Mining reportedly acquires Big Dam for $5m. It is the first.",
        2: "Big Dam was sold: zambezi rail buys it. ACME supplies diesel to Big Dam and Zambezi Rail supplies Acme.",
        3: "Nobody acquires Acme.",
        4: None,
        5: "😀 Acme acquires nothing. The Acmes acquire.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = A.relations(docs, "doc_id", "text", names, "name", {"acquires": r"\bacquires?\b", "supplies": r"\bsupplies\b", "buys": "buys"}).collect()
    assert {(r.source_id, r.subject, r.predicate, r.object) for r in got} == {
        (1, "acme mining", "acquires", "big dam"), (2, "zambezi rail", "buys", None), (2, "acme", "supplies", "big dam"), (5, "acme", "acquires", None),
    }
    for r in got:
        t = texts[r.source_id]
        assert t[r.char_start : r.char_end] == r.quote and t[r.subject_start :].lower().startswith(r.subject)
        assert r.object is None or t[r.object_start :].lower().startswith(r.object)
    assert {r.certainty for r in got if r.source_id == 1} == {"reported"}
