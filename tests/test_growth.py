"""What larger tables bring to light: joins that must not be broadcast, shuffles of pairs, calendars."""

import datetime as dt
import random

from pyspark.sql import functions as F

from annalist.llm import templates
from annalist.operators import documents as D
from annalist.operators import evaluate as V
from annalist.operators import events as E
from annalist.operators import learned as Ln
from annalist.operators import linkage as Lk
from annalist.operators import resolve as R
from annalist.operators import timing as Tm
from annalist.operators import vectors as Vx
from annalist.plans import matching, vault
from annalist.sources import runs
from annalist.sources import store as St
from annalist.sources.commits import CommitLog


def final_plan(df):
    """The plan that was executed."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_meet_without_a_broadcast(spark):
    plan = final_plan(D.near_fingerprints(spark.range(1000).select(F.col("id").alias("simhash"))))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_forecast_shift_counts_months_by_the_calendar(spark):
    days = [("2024-02-29", "2023-08-30"), ("2024-02-28", "2023-08-30"), ("2024-02-29", "2023-08-29"), ("2024-08-30", "2024-02-29"), ("2024-08-28", "2024-02-29"), ("2024-06-30", "2023-12-31")]
    rows = [(k, n, dt.datetime.fromisoformat(d)) for k, pair in enumerate(days) for n, d in enumerate(pair)]
    found = Tm.forecast_shift(spark.createDataFrame(rows, "k int, n int, day timestamp_ntz"), "k", ["n"], "day")
    assert sorted(r.k for r in found.collect()) == [0, 2, 3, 5]


def test_external_pairs_are_not_shuffled_and_frequent_ids_are_dealt_out(spark):
    ids = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    none = F.lit(None).cast("string")
    left = spark.range(60).select(F.col("id").alias("mention_id"), ids(("a", F.lit("hot")), ("b", (F.col("id") % 5).cast("string")), ("c", none)).alias("external_ids"))
    right = spark.range(50).select(F.col("id").alias("entity_id"), ids(("a", F.when(F.col("id") % 2 == 0, "hot")), ("b", (F.col("id") % 5).cast("string"))).alias("external_ids"))
    left = left.unionAll(left.filter("mention_id < 3"))
    df = R.match_external(left, right, block_rows=7)
    rows = df.collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == {(m, e) for m in range(60) for e in range(50) if e % 2 == 0 or m % 5 == e % 5}
    plan = final_plan(df)
    assert "[mention_id#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line and "entity_id" in line.split("hashpartitioning")[1].split("]")[0])
    spread = df.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert spread.count() > 1 and R.match_external(left.filter("false"), right).count() == 0


def test_pairs_of_customers_are_not_shuffled(spark, sf):
    for df in (matching.linkage_patterns(spark, sf), matching.linked_customers(spark, sf)):
        dealt = [line.split("hashpartitioning(")[1] for line in final_plan(df).splitlines() if "hashpartitioning(" in line]
        assert dealt and not any("entity_id" in line for line in dealt)


def test_best_by_pattern_equals_best(spark):
    pairs = spark.range(3000).select((F.col("id") % 40).alias("mention_id"), F.col("id").alias("entity_id"), (F.col("id") % 3).cast("int").alias("x"), F.when(F.col("id") % 7 > 0, (F.col("id") % 2).cast("int")).alias("y"))
    weights = Lk.estimate(Lk.patterns(pairs, ("x", "y")), ("x", "y"))
    for w in (weights, None):
        show = lambda df: sorted((r.mention_id, r.entity_id, round(r.confidence, 9), r.decision) for r in df.collect())
        assert show(Lk.best_by_pattern(pairs, w, ("x", "y"))) == show(Lk.best(Lk.probability(pairs, w)))


def test_vectors_meet_as_matrix_products_and_ties_and_odd_rows_stay(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    rows += [(k, rows[5][1]) for k in range(300, 340)] + [(340, None), (341, [0.0] * 8), (342, [None] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = R.vector_topk(df.filter("id % 20 = 0"), df, "id", "v", 10, blocks=3)
    assert "FlatMapCoGroupsInArrow" in final_plan(found)

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 9)

    whole = {}
    for key, v in rows[:341:20]:
        best = sorted((-cosine(v, w), k) for k, w in rows[:340] if k != key) if v else [(None, k) for k in range(10)]
        whole |= {(key, n): k for n, (_, k) in enumerate(best[:10], 1)}
    assert {(r["query"], r["rank"]): r["id"] for r in found.collect()} == whole
    index = Vx.fit_cells(df, "id", "v", cells=6)
    near = Vx.search(df.filter("id % 20 = 0"), df, index, "id", "v", k=10, exact=True, cell_rows=7)
    assert "FlatMapCoGroupsInArrow" in index_plan(df, index)
    assert {(r["query"], r["rank"]): r["id"] for r in near.collect()} == {a: k for a, k in whole.items() if a[0] != 340}


def index_plan(df, index):
    """The plan of the blocks of one search without its first pass, which is kept."""
    return Vx.search(df.filter("id % 20 = 0"), df, index, "id", "v", exact=True, probes=1)._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_not_shuffled_and_parts_count_as_their_tokens(spark):
    docs = spark.createDataFrame([(k, " ".join(random.Random(k).choices(["ab", "bcd", "ca", "dda", "élan"], k=k % 9)), "xyz"[k % 3]) for k in range(60)], "id long, text string, label string")
    labels, words = Ln.learn(docs, Ln.words_of(F.col("text")), "label")
    plan = final_plan(Ln.predict(docs, Ln.words_of(F.col("text")), "id", labels, words))
    dealt = [line.split("hashpartitioning(")[1].split("]")[0] for line in plan.splitlines() if "hashpartitioning(id#" in line]
    assert dealt and not any("token#" in line for line in dealt)
    labels, grams = Ln.learn(docs, Ln.grams_of(F.col("text")), "label")
    whole = Ln.predict(docs, Ln.grams_of(F.col("text")), "id", labels, grams)
    labels, grams = Ln.learn(docs, Ln.words_of(F.col("text")), "label", parts=Ln.grams_in)
    show = lambda df: sorted((r.id, r.label, round(r.score, 7)) for r in df.collect())
    for most in (0, 1000):
        assert show(Ln.predict(docs, Ln.words_of(F.col("text")), "id", labels, grams, broadcast_words=most, parts=Ln.grams_in)) == show(whole)


def test_parts_of_many_words_are_counted_and_scored_where_texts_are_read(spark):
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choices(letters, k=rnd.randint(1, 9)))
    rows = [(k, " ".join(word(("aab", "abb", "abñ𝒳")[k % 3]) for _ in range(40)), (10, 20, 30)[k % 3]) for k in range(90)] + [(90, None, 10), (91, "", None), (92, "1 zz 2", 20)]
    docs = spark.createDataFrame(rows, "id long, text string, label int")
    labels, grams = Ln.learn(docs, Ln.grams_of(F.col("text")), "label")
    show = lambda df: sorted((r.id, r.label, round(r.score, 7)) for r in df.collect())
    whole = show(Ln.predict(docs, Ln.grams_of(F.col("text")), "id", labels, grams))
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (read.add(1), t)[1], "string").asNondeterministic()
    labels, grams = Ln.learn(docs, Ln.words_of(seen("text")), "label", parts=Ln.grams_in)
    n = grams.count()
    assert docs.select(F.explode(Ln.words_of(F.col("text")))).distinct().count() > 2 * n
    found = Ln.predict(docs, Ln.words_of(seen("text")), "id", labels, grams, broadcast_words=n, parts=Ln.grams_in)
    plan = final_plan(found)
    assert "Exchange" not in plan and "MapInArrow" in plan
    assert read.value == 2 * len(rows) - 1  # the row without a label teaches nothing
    assert show(found) == whole
    for most in (0, n // 3, n - 1):  # some grams meet the texts by shuffle
        df = Ln.predict(docs, Ln.words_of(F.col("text")), "id", labels, grams, broadcast_words=most, parts=Ln.grams_in)
        assert show(df) == whole and "Exchange" in final_plan(df)
    assert Ln.predict(docs.filter("false"), Ln.words_of(F.col("text")), "id", labels, grams, parts=Ln.grams_in).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["ab", None, "", "ab"]), (4, ["ab", "ab"])], "id long, words array<string>")
    for most in (0, n):
        got = {r.id: (r.label, r.score) for r in Ln.predict(odd, F.col("words"), "id", labels, grams, broadcast_words=most, parts=Ln.grams_in).collect()}
        assert got[1] == got[2] and got[3] == got[4]
    assert Ln.learn(docs.filter("label IS NULL"), Ln.words_of(F.col("text")), "label", parts=Ln.grams_in)[1].count() == 0


def test_languages_are_measured_on_the_rows_that_are_predicted(spark, sf, monkeypatch):
    docs, found = matching._languages(spark, sf)
    held = docs.filter(Ln.held_out(F.col("doc_id"))).select("doc_id", "lang")
    whole = V.evaluate(found.join(held, "doc_id"), "label", "lang").select("metric", F.round("value", 6).alias("value")).collect()
    given, predict = [], Ln.predict
    monkeypatch.setattr(Ln, "predict", lambda docs, *args, **more: given.append(docs) or predict(docs, *args, **more))
    assert sorted(matching.learned_language_metrics(spark, sf).collect()) == sorted(whole)
    assert sorted(r.doc_id for r in given[0].collect()) == sorted(r.doc_id for r in held.collect())


def test_runs_of_words_are_found_in_arrays():
    words = ["a", "", "élan", "𝒳y", "ab", "a", "the"]
    names, places, sizes = Ln.grams_in(words)
    plain = [[f" {w} "[i : i + 3] for i in range(len(w))] for w in words]
    assert len(names) == len(set(names)) and [names[i] for i in places] == [x for p in plain for x in p] and sizes.tolist() == [len(p) for p in plain]
    assert Ln.grams_in([])[0] == [] and Ln.grams_in([""])[0] == []


def test_documents_arrive_in_as_many_files_as_they_need(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(vault, "FILE_ROWS", 20, raising=False)
    monkeypatch.setattr(vault, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    found = vault.ingested_texts(spark, sf).count()
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert found == rows.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert len(list((tmp_path / "inbox" / "in").glob("part-*"))) >= rows.count() // 20 and len(list((tmp_path / "inbox" / "out").glob("batch=*"))) == 2


def test_an_append_numbers_and_chains_in_one_shuffle(spark):
    rows = spark.range(200).select((F.col("id") % 7).cast("string").alias("stream_id"), (F.col("id") * 13 % 50).alias("at"), F.col("id").alias("id"))
    heads = spark.createDataFrame([("0", 4, "aa"), ("3", 1, "bb"), ("none", 9, "cc")], "stream_id string, head long, hash string")
    content = E.canonical("sequence", "id")
    df = E.extend_chain(rows, content, heads, ["stream_id"], ("at", "id"))
    plan = final_plan(df).split("Initial Plan")[0]
    assert plan.count("hashpartitioning(stream_id") == 1 and "Join" not in plan
    numbered = E.assign_sequence(rows, ["stream_id"], ("at", "id"), heads.select("stream_id", "head"))
    wanted = E.hash_chain(numbered, content, ["stream_id"], seeds=heads.select("stream_id", "hash"))
    assert sorted(df.collect()) == sorted(wanted.select(*df.columns).collect())
    alone = E.hash_chain(E.assign_sequence(rows, ["stream_id"], ("at", "id")), content, ["stream_id"])
    assert sorted(E.extend_chain(rows, content, None, ["stream_id"], ("at", "id")).collect()) == sorted(alone.select(*df.columns).collect())


def test_a_lookup_of_many_keys_asks_no_filters(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    index = runs.Runs(log, "t", prefix_keys=5_000)
    keys = lambda a, b: spark.range(a, b).select(runs.key_of(F.col("id")).alias("key"))
    assert log.commit(log.snapshot(), {"t": [index.stage(keys(0, 40_000), 40_000)]})
    now = log.snapshot()
    assert index.find(keys(20_000, 60_000), now).count() == 20_000 and (index.reads.filters, index.reads.keys) == (0, 16)
    assert index.find(keys(39_000, 45_000), now).count() == 1_000 and index.reads.filters == 16
    # absent keys that a filter would let pass
    run = now.tables["t"][0]
    blocks = spark.read.parquet(f"{log.folder('t', run['id'])}/blocks")
    asked = keys(40_000, 140_000).select(index._prefix(1).alias("prefix"), index._block(run["blocks"]), *index._marks())
    passed = asked.join(blocks, ["prefix", "block"])
    for i in range(runs.WORDS):
        passed = passed.filter(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
    assert passed.count() <= 40
    # a run of before, whose filters have another form, is read without them
    del run["blocks"]
    assert index.find(keys(39_990, 40_010), now).count() == 10 and index.reads.filters == 0


def test_events_whose_ids_come_once_are_not_shuffled_to_compare_them(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    rows = spark.range(100).select(runs.key_of(F.col("id")).alias("key"), F.col("id").cast("string").alias("content"), F.timestamp_seconds("id").alias("recorded_at"))
    once, twice = store._once(rows, f"{tmp_path}/a")
    assert once is rows and twice.count() == 0
    more = rows.unionByName(rows.filter("content < '2'")).unionByName(rows.filter("content = '7'").withColumn("content", F.lit("other")))
    once, twice = store._once(more, f"{tmp_path}/b")
    assert sorted(r.content for r in once.collect()) == sorted(map(str, range(100))) and [r.content for r in twice.collect()] == ["other"]


def test_texts_are_shuffled_once_to_lose_lines_whatever_their_number(spark):
    """A broadcast at small sizes only would let the shuffle grow faster than the texts; copies of one text are dealt out."""
    names = [f"spark.sql.adaptive.{k}" for k in ("advisoryPartitionSizeInBytes", "skewJoin.skewedPartitionThresholdInBytes", "skewJoin.skewedPartitionFactor", "coalescePartitions.enabled")]
    sent, word = {}, lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(k, f"this line is in all of the texts\nown {word(7919 * k)} words {word(k)} of text {word(31 * k)}") for k in range(2_000)]
    rows += [(k, "copied again and again to here\nthis line is in all of the texts") for k in range(2_000, 6_000)]
    for n in (2_000, 6_000):
        for name, value in zip(names, ("16k", "16k", "1.5", "false") if n == 6_000 else ("", "", "", "")):
            spark.conf.set(name, value) if value else spark.conf.unset(name)
        df = templates.drop_recurring_lines(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(8))
        found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}
        assert found == {k: (t.split("\n")[k < 2_000], 2, 1) for k, t in rows[:n]}
        sent[n] = final_plan(df).split("== Initial Plan ==")[0]
    for name in names:
        spark.conf.unset(name)
    assert all("BroadcastHashJoin [doc" not in x and "SortMergeJoin" in x for x in sent.values())
    assert "skew=true" in sent[6_000] and "skew=true" not in sent[2_000]
