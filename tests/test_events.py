import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.operators import events as E
from annalist.sources.store import EventStore

ORDER = ["sequence"]


def log(spark, rows):
    return spark.createDataFrame(rows, "id string, stream_id string, sequence long, value string, supersedes string, at int")


def test_cut_comes_before_supersession(spark):
    rows = log(spark, [("a", "s", 1, "old", None, 1), ("b", "s", 2, "new", "a", 5)])
    then = E.current_events(E.as_of(rows, F.lit(3), "at"), supersedes="supersedes")
    assert [r.value for r in then.collect()] == ["old"]
    now = E.current_events(E.as_of(rows, F.lit(9), "at"), supersedes="supersedes")
    assert [r.value for r in now.collect()] == ["new"]


def test_superseding_a_superseding_event_and_twice_is_the_same(spark):
    rows = log(spark, [("a", "s", 1, "1", None, 1), ("b", "s", 2, "2", "a", 2), ("c", "s", 3, "3", "b", 3)])
    once = E.current_events(rows, supersedes="supersedes")
    assert [r.id for r in once.collect()] == ["c"]
    assert [r.id for r in E.current_events(once, supersedes="supersedes").collect()] == ["c"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**31))
def test_replay_in_any_order_gives_the_same_state_and_hash(spark, seed):
    rows = [(f"e{k}", f"s{k % 3}", k // 3 + 1, str(k * 7 % 5), None, k) for k in range(30)]
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    hashes = {tuple(E.frame_hash(E.project_state(log(spark, x).repartition(3), ["stream_id"], ["sequence"], ["value"])).first()) for x in (rows, shuffled)}
    assert len(hashes) == 1


def test_frame_hash_sees_a_changed_field_and_a_repeated_row(spark):
    rows = [("e", "s", 1, "x", None, 1), ("f", "s", 2, "y", None, 2)]
    base = E.frame_hash(log(spark, rows)).first().hash
    assert E.frame_hash(log(spark, [rows[0], (*rows[1][:3], "z", None, 2)])).first().hash != base
    assert E.frame_hash(log(spark, [*rows, rows[0]])).first().hash != base
    assert E.frame_hash(log(spark, [])).first().rows == 0


def test_chain_detects_any_change_and_a_missing_event(spark):
    rows = log(spark, [(f"e{k}", "s", k, f"v{k}", None, k) for k in range(1, 6)])
    content = E.canonical("id", "value")
    chained = E.hash_chain(rows, content, ["stream_id"])
    assert E.chain_breaks(chained, content, ["stream_id"]).count() == 0
    changed = chained.withColumn("value", F.when(F.col("sequence") == 3, "other").otherwise(F.col("value")))
    assert [r.sequence for r in E.chain_breaks(changed, content, ["stream_id"]).collect()] == [3]
    assert [r.sequence for r in E.chain_breaks(chained.filter("sequence <> 3"), content, ["stream_id"]).collect()] == [4]


def event(k, **more):
    base = {
        "id": f"e{k}", "stream_type": "entity", "stream_id": "s1", "event_type": "SignalScored", "payload": '{"v": %d}' % k, "evidence_ids": ["x"], "certainty": "stated",
        "actor_type": "system", "recorded_at": dt.datetime(2024, 1, 1, 0, 0, k),
    }
    return base | more


SCHEMA = "id string, stream_type string, stream_id string, event_type string, payload string, evidence_ids array<string>, certainty string, actor_type string, actor_id string, proposal_id string, supersedes_event_id string, recorded_at timestamp"


def frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"event_type": "Nothing"}, "unknown_event_type"),
        ({"stream_type": "x"}, "unknown_stream_type"),
        ({"payload": "{"}, "bad_payload"),
        ({"evidence_ids": []}, "no_evidence"),
        ({"evidence_ids": None}, "no_evidence"),
        ({"event_type": "DealStageChanged", "evidence_ids": [], "actor_type": "human", "payload": '{"reason": "asked"}'}, None),
        ({"event_type": "DealStageChanged", "evidence_ids": [], "actor_type": "human"}, "no_evidence"),
        ({"event_type": "ContactAdded", "evidence_ids": []}, "actor_not_human"),
        ({"event_type": "ContactAdded", "evidence_ids": [], "actor_type": "human"}, None),
        ({"event_type": "ClaimRetracted", "evidence_ids": []}, "no_reason"),
        ({"event_type": "ClaimRetracted", "evidence_ids": [], "payload": '{"reason": "wrong"}'}, None),
        ({"actor_type": "agent"}, "agent_without_proposal"),
        ({"actor_type": "agent", "proposal_id": "p"}, None),
    ],
)
def test_reason_codes(spark, change, reason):
    assert frame(spark, [event(1, **change)]).select(E.reason_code().alias("r")).first().r == reason


def test_store_numbers_chains_refuses_and_reads_the_past(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    assert store.append_events(frame(spark, [event(1), event(2), event(3, evidence_ids=[])])) == 1
    assert store.append_events(frame(spark, [event(4, supersedes_event_id="e2")])) == 0
    rows = store.read().orderBy("sequence").collect()
    assert [(r.id, r.sequence) for r in rows] == [("e1", 1), ("e2", 2), ("e4", 3)]
    assert rows[2].prev_hash == rows[1].hash
    assert store.chain_breaks().count() == 0
    assert [r.reason_code for r in store.quarantine.read().collect()] == ["no_evidence"]
    assert store.state(["stream_id"], ["id"]).first().id == "e4"
    assert store.state(["stream_id"], ["id"], F.lit("2024-01-01 00:00:03").cast("timestamp")).first().id == "e2"
    for forbidden in (store.overwrite, store.update, store.delete, store.truncate):
        with pytest.raises(PermissionError):
            forbidden()
