"""Nulls and tampering in the log, heads, the other tables, delivery, guards, candidates."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from annalist import model
from annalist.operators import agents as A
from annalist.operators import documents as D
from annalist.operators import events as E
from annalist.operators import govern as G
from annalist.operators import resolve as R
from annalist.operators import timing as Tm
from annalist.sources import store as St
from annalist.streaming import streams

FIELDS = [f.name for f in model.EVENT.fields]


def event(k, **other):
    row = {
        "id": f"e{k}", "stream_type": "entity", "stream_id": "s1", "event_type": "SignalScored", "payload": '{"n": 1}', "evidence_ids": ["x"], "certainty": "stated", "actor_type": "system",
        "actor_id": "a", "recorded_at": dt.datetime(2024, 1, 1, 0, k),
    } | other
    return tuple(row.get(f) for f in FIELDS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), model.EVENT)


@pytest.mark.parametrize(("column", "reason"), [("event_type", "unknown_event_type"), ("stream_type", "unknown_stream_type"), ("actor_type", "unknown_actor_type"), ("stream_id", "missing_value"), ("id", "missing_value"), ("recorded_at", "missing_value"), ("payload", "bad_payload"), ("evidence_ids", "no_evidence")])
def test_a_null_is_refused(spark, tmp_path, column, reason):
    store = St.EventStore(spark, str(tmp_path))
    assert store.append_events(frame(spark, event(1, **{column: None}), event(2))) == 1
    assert [r.id for r in store.read().collect()] == ["e2"] and [r.reason_code for r in store.quarantine.read().collect()] == [reason]


def test_optional_nulls_are_taken(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    assert store.append_events(frame(spark, event(1, certainty=None, actor_id=None))) == 0


def test_appends_go_on_from_the_heads(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    for k in range(3):
        assert store.append_events(frame(spark, event(2 * k), event(2 * k + 1), event(2 * k, id=f"o{k}", stream_id="s2"))) == 0
    rows = store.read().orderBy("stream_id", "sequence").collect()
    assert [r.sequence for r in rows] == [1, 2, 3, 4, 5, 6, 1, 2, 3] and rows[5].prev_hash == rows[4].hash and rows[6].prev_hash == ""
    assert store.chain_breaks().count() == 0 and store.cut_ends().count() == 0
    assert {(r.stream_id, r.head, r.hash) for r in store.heads().collect()} == {("s1", 6, rows[5].hash), ("s2", 3, rows[8].hash)}


def test_lost_heads_are_made_again(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    store.append_events(frame(spark, event(1), event(2)))
    store.head_log = St.AppendOnly(spark, str(tmp_path) + "/other", model.HEAD)
    store.repair_heads()
    store.append_events(frame(spark, event(3)))
    assert sorted(r.sequence for r in store.read().collect()) == [1, 2, 3] and store.chain_breaks().count() == 0


def test_tampering_is_seen(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    store.append_events(frame(spark, *[event(k) for k in range(5)]))
    log = St._hashed(store.read()).cache()
    last, n = F.col("sequence") == 5, lambda rows: E.chain_breaks(rows, St.event_content()).count()
    assert n(log) == 0
    assert n(log.withColumn("hash", F.when(~last, F.col("hash")))) == 1
    changed = log.withColumn("payload", F.when(last, "{}").otherwise(F.col("payload"))).withColumn("prev_hash", F.when(~last, F.col("prev_hash")))
    assert n(changed) == 1
    assert n(log.filter("sequence <> 3")) == 1 and n(log.withColumn("sequence", F.when(~last, F.col("sequence")))) >= 1
    assert n(log.filter("sequence < 5")) == 0
    assert [(r.stream_id, r.head, r.last) for r in E.cut_ends(log.filter("sequence < 5"), store.heads()).collect()] == [("s1", 5, 4)]
    assert [(r.head, r.last) for r in E.cut_ends(log.filter("false"), store.heads()).collect()] == [(5, None)]


def test_erasing_a_person_leaves_the_chain_whole(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    keys = spark.createDataFrame([("p", bytearray(b"0" * 16))], "person_id string, key binary")
    sealed = keys.select(G.seal(F.lit("Ann"), F.col("key"))).first()[0]
    store.append_events(frame(spark, event(1, event_type="EntityAttributeAsserted", payload=f'{{"person_id": "p", "name": "{sealed}"}}')))
    people = store.read().select(F.lit("p").alias("person_id"), F.get_json_object("payload", "$.name").alias("name"))
    assert [r.name for r in G.unseal(people, keys, ["name"]).collect()] == ["Ann"]
    left = G.erase(keys, spark.createDataFrame([("p",)], "person_id string"))
    assert [r.name for r in G.unseal(people, left, ["name"]).collect()] == [None] and store.chain_breaks().count() == 0


def test_approvals_become_events_of_the_log(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    at = dt.datetime(2024, 1, 2)
    proposals = spark.createDataFrame(
        [(f"p{k}", "entity", "s1", kind, "{}", ["x"], "stated", 0.5, "bot", at) for k, kind in enumerate(["EntityMerged", "SignalScored", "DealIdentified"])],
        "id string, stream_type string, stream_id string, event_type string, payload string, evidence_ids array<string>, certainty string, confidence double, created_by string, created_at timestamp",
    )
    approvals = spark.createDataFrame([("p0", "ann", None, at), ("p2", "bot", None, at)], "proposal_id string, actor_id string, payload string, recorded_at timestamp")
    events = G.approve(proposals, approvals).unionByName(G.auto_approve(proposals))
    assert store.append_events(events) == 0
    assert {(r.proposal_id, r.actor_type) for r in store.read().collect()} == {("p0", "human"), ("p1", "agent")} and store.chain_breaks().count() == 0
    alerts = G.alert_events(store.read().withColumn("tier", F.when(F.col("proposal_id") == "p1", 0).otherwise(1)))
    assert store.append_events(alerts) == 0 and store.read().filter("event_type = 'AlertRaised'").count() == 1


def test_the_other_tables(spark, tmp_path):
    tables = St.tables(spark, str(tmp_path))
    texts = spark.createDataFrame([("s", "u", "é line\r\nend")], "source_id string, text_uri string, text string")
    for _ in range(2):
        St.write_texts(tables["texts"], texts)
    kept = tables["texts"].read()
    assert [r.text for r in kept.collect()] == ["é line\nend"]
    rows = spark.createDataFrame([("a", "s", 2, 6, "line"), ("b", "s", 1, 5, "line"), ("c", None, 0, 1, None)], "id string, source_id string, char_start int, char_end int, quote string")
    St.write_evidence(tables["evidence"], rows, kept)
    assert {r.id: r.verified for r in tables["evidence"].read().collect()} == {"a": True, "b": False, "c": False}
    St.log_security(tables["security_log"], spark.createDataFrame([(dt.datetime(2024, 1, 1), "ann", "erase", "p")], model.SECURITY_LOG))
    assert tables["security_log"].read().count() == 1
    with pytest.raises(PermissionError):
        tables["security_log"].delete()


def test_failed_channels_are_kept_and_sent_again(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "in"))
    got, broken = [], [True]

    def mail(batch):
        if broken[0]:
            raise OSError("no mail")
        got.extend(r.id for r in batch.collect())

    rows = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = []
    channels = {"mail": mail, "screen": lambda b: seen.extend(r.id for r in b.collect())}
    streams.deliver(rows(), channels, str(tmp_path / "c1"), failures=str(tmp_path / "failed")).awaitTermination(60)
    assert sorted(seen) == [1, 2] and not got
    broken[0] = False
    assert streams.redeliver(spark, str(tmp_path / "failed"), {"mail": mail}, ["id"]) == {"mail": 2} and sorted(got) == [1, 2]
    broken[0] = True
    query = streams.deliver(rows(), channels, str(tmp_path / "c2"))
    with pytest.raises(Exception, match="channels failed"):
        query.awaitTermination(60)


def test_retry_quarantine_and_guard(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in range(6)], "k long")
    calls = []

    def agent(given):
        calls.append(given.count())
        return given.select("k", F.when((F.col("k") % 3 == 0) & (F.lit(len(calls)) == 1) | (F.col("k") == 3), "{}").otherwise('{"n": 1}').alias("output"))

    said = A.with_retry(agent, rows, "k", "output", {"n": "int"})
    assert {r.k: r.reason_code for r in said.collect()} == {k: "bad_payload" if k == 3 else None for k in range(6)} and calls == [6, 2]
    table = St.AppendOnly(spark, str(tmp_path), model.QUARANTINE)
    table.append(A.quarantined(said, "k", "agent", F.col("output"), F.lit(dt.datetime(2024, 1, 1))))
    assert [(r.id, r.step, r.reason_code) for r in table.read().collect()] == [("3", "agent", "bad_payload")]


def test_candidates_feed_the_decision(spark):
    mentions = spark.createDataFrame([("m1", "Acme Mining"), ("m2", "Zebra Haulage"), ("m3", None), ("m4", "")], "mention_id string, name string")
    entities = spark.createDataFrame([(1, "Acme Mining"), (2, "Acme Minings"), (3, "Acne Mining"), (4, "Other"), (5, None)], "entity_id long, name string")
    found = R.candidates(mentions, entities, k=2, least=0.5)
    assert [(r.entity_id, r.rank) for r in found.filter("mention_id = 'm1'").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    decided = {r.mention_id: (r.entity_id, r.decision) for r in R.decide(mentions, found.filter("rank = 1").filter("confidence > 0.8")).collect()}
    assert decided["m1"] == (1, "match") and decided["m2"] == (None, "new")
    assert R.candidates(mentions.filter("false"), entities).count() == 0 and R.candidates(mentions, entities.filter("false")).count() == 0


def test_near_fingerprints_equal_all_pairs(spark):
    import random

    rnd = random.Random(1)
    prints = [rnd.getrandbits(60) for _ in range(40)]
    for p in prints[:]:
        for _ in range(3):
            q = p
            for b in rnd.sample(range(60), rnd.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
    pairs = {(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3}
    found = D.near_fingerprints(spark.createDataFrame([(p,) for p in [*prints, None]], "simhash long"))
    assert {(r.a, r.b) for r in found.collect()} == pairs and len(pairs) > 50


@pytest.mark.parametrize(
    ("at", "cron", "due"),
    [
        ("2024-01-01 06:00", "0 6 * * 1", True), ("2024-01-01 06:01", "0 6 * * 1", False), ("2024-01-07 06:00", "0 6 * * 0", True), ("2024-01-07 06:00", "0 6 * * 7", True), ("2024-01-02 06:00", "0 6 * * 1-5", True),
        ("2024-01-02 06:20", "*/20 * * * *", True), ("2024-01-02 06:25", "5/20 * * * *", True), ("2024-01-02 06:21", "1,21-23 * 2 1 *", True), ("2024-01-02 06:21", "bad", False), ("2024-01-02 06:21", None, False),
    ],
)
def test_cron(spark, at, cron, due):
    row = spark.createDataFrame([(dt.datetime.fromisoformat(at), cron)], "t timestamp_ntz, c string")
    assert row.select(Tm.cron_due(F.col("t"), F.col("c")).alias("x")).first().x is due


def test_a_new_event_is_visible_soon(spark, tmp_path):
    """From the end of an append to the projection that shows it, with a trigger of half a second."""
    store = St.EventStore(spark, str(tmp_path / "log"))
    store.append_events(frame(spark, event(1)))
    events = streams.event_stream(spark, store.path, model.EVENT)
    query = streams.project_stream(events, store.read, str(tmp_path / "state"), str(tmp_path / "check"), ["stream_id"], ["id"], {"processingTime": "500 milliseconds"})
    try:
        query.processAllAvailable()
        took = []
        for k in range(2, 5):
            store.append_events(frame(spark, event(k)))
            began = time.monotonic()
            while [r.id for r in streams.read_projection(spark, str(tmp_path / "state"), ["stream_id"]).collect()] != [f"e{k}"]:
                assert time.monotonic() - began < 30
                time.sleep(0.05)
            took.append(time.monotonic() - began)
        print(f"visible after {[round(t, 2) for t in took]} s")
    finally:
        query.stop()
