import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_dedup import shingles, words


def test_pipeline_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, sf).cache()
        counts.append(docs.count())
        assert docs.columns == (columns if k < 4 else [*columns, "ids", "round_trip"]), name
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    rows = docs.collect()
    texts = [r.text for r in rows]
    assert len({b" ".join(words(t)) for t in texts}) == len(texts)
    sets = [s for s in map(shingles, texts) if s]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert 100 * len(a & b) < 80 * len(a | b)
    assert not any(b in " ".join(t.split()) for t in texts for b in bench)
    assert all(r.round_trip for r in rows)


def test_run_applies_all_stages(spark, sf):
    assert cp.ORACLE_SQL is None
    out = cp.run(spark, sf)
    assert "ids" in out.columns and out.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_nulls_repeats_and_nothing(spark, sf, name):
    stage = dict(cp.STAGES)[name]
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (3, long, "en"), (4, long.upper(), "en"), (None, "some other text that stands here", "en"), (5, "Plain words stand in this text as well.", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(7)).withColumn("key", F.lit("k")).withColumn("id", F.lit(0))
    out = stage(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    kept = out.collect()
    assert 0 < len(kept) <= len(rows) and {r.score for r in kept} == {7}
    assert stage(spark, docs.filter("false"), sf).count() == 0


def test_rows_without_an_id_are_their_texts(spark, sf):
    from annalist.llm import setsketch

    words = lambda x: [f"{x}{k}" for k in range(200)]
    near = lambda x, end: " ".join([*words(x)[:-1], end])
    rows = [(5, near("a", "x")), (None, near("a", "y")), (None, near("b", "x")), (None, near("b", "y")), (None, near("c", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.component_id, r.kept) for r in setsketch.near_components(docs).collect()]
    assert sorted(found, key=str) == sorted([(5, 5, True), (None, 5, False), (None, None, True), (None, None, False), (None, None, True)], key=str)
    kept = [r.text for r in cp.drop_near_copies(spark, docs, sf).collect()]
    assert len(kept) == 3 and near("a", "x") in kept and near("c", "x") in kept
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, leak), (None, near("c", "x")), (1, near("b", "x")), (2, leak), (None, None)], "doc_id long, text string")
    assert {r.text for r in cp.drop_leaks(spark, docs, sf).collect()} == {near("c", "x"), near("b", "x"), None}


def _kept(spark, stage, rows, sf):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf).collect()), key=str)


def test_no_copies_are_left(spark, sf):
    """Rows that share an id, repeat, or have none: one of each text stays, and one of each group of near copies."""
    words = lambda x, end="z": " ".join([f"{x}{k}" for k in range(200)] + [end])
    a, b, c, d, e = (words(x) for x in "abcde")
    rows = [(3, a, "en"), (3, a, "en"), (4, a.upper(), "en"), (None, b, "en"), (None, b, "de"), (None, b.upper(), "de"), (5, c, "en"), (5, d, "en"), (None, "", "en"), (None, None, "en"), (6, " \n", "en"), (None, e, "en"), (7, e, "en")]
    got = _kept(spark, cp.drop_copies, rows, sf)
    assert [(i, (t or "").lower()) for i, t in got] == sorted([(4, a.lower()), (5, c), (5, d), (6, " \n"), (7, e), (None, ""), (None, b)], key=str)
    # the near copy of 5 shares its id with another text; of rows without words all stay
    rows = [(3, a, "en"), (3, a, "en"), (5, words("a", "y"), "en"), (5, c, "en"), (8, d, "en"), (8, words("d", "y"), "en"), (None, b, "en"), (None, words("b", "y"), "en"), (None, b, "en"), (9, None, "en"), (9, None, "en"), (10, "", "en")]
    got = _kept(spark, cp.drop_near_copies, rows, sf)
    assert [i for i, _ in got].count(3) == 1 and (5, c) in got and (5, words("a", "y")) not in got
    assert sum(i == 8 for i, _ in got) == 1 and sum((t or "").startswith("b0") for _, t in got) == 1
    assert sum(i in (9, 10) for i, _ in got) == 3 and len(got) == 7


def test_a_leak_does_not_drag_rows_of_its_id_along(spark, sf):
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = " ".join(f"w{k}" for k in range(100))
    assert _kept(spark, cp.drop_leaks, [(1, leak, "en"), (1, clean, "en"), (None, "x " + leak, "en"), (None, clean, "en"), (2, None, "en")], sf) == [(1, clean), (2, None), (None, clean)]


def test_texts_that_share_an_id_make_no_leak_together(spark):
    from annalist.llm import decontam

    item = [f"q{k}" for k in range(10)]
    a = " ".join([f"x{k}" for k in range(4)] + item[:5] + [f"r{k}" for k in range(10)])
    b = " ".join([f"p{k}" for k in range(4)] + item[:9])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for ids in ((1, 2), (1, 1), (None, None)):
        docs = spark.createDataFrame([(ids[0], a), (ids[1], b)], "doc_id long, text string")
        apart = [decontam.contaminated(docs.filter(F.col("text") == t), bench).collect() for t in (a, b)]
        together = decontam.contaminated(docs, bench).collect()
        assert sorted(map(str, together)) == sorted(map(str, [*apart[0], *apart[1]])), ids
    again = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (1, "other " + " ".join(item))], "doc_id long, text string")
    assert [(r.doc_id, r.similarity) for r in decontam.contaminated(again, bench).collect()] == [(1, 1.0)]


@pytest.mark.parametrize(("name", "ids"), [("exact_dedup", [2, 4, 5, None]), ("near_dedup", [1, 2, 3, 5, None]), ("decontamination", [1, 2, 3, 3, 4, 5, None]), ("encoding", [1, 2, 3, 3, 4, 5, None])])
def test_rows_that_stages_keep(spark, sf, name, ids):
    """The null and the empty text are equal but no near copies, as they have no words; the long ones are both."""
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (3, long, "en"), (4, long.upper(), "en"), (None, "some other text that stands here", "en"), (5, "Plain words stand in this text as well.", "de")]
    assert [i for i, _ in _kept(spark, dict(cp.STAGES)[name], rows, sf)] == ids
