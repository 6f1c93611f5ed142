import datetime as dt

from annalist.operators import corrections as C
from annalist.operators import events as E
from annalist.sources.store import EventStore
from tests.test_events import event, frame

LATER = dt.datetime(2024, 1, 2)


def test_correction_and_retraction_hide_but_keep(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.append_events(frame(spark, [event(1), event(2), event(3)]))
    fix = spark.createDataFrame(
        [("e1", "n1", '{"v": 9}', ["x"], "stated", "ann", LATER), ("none", "n2", "{}", ["x"], "stated", "ann", LATER)],
        "event_id string, new_id string, payload string, evidence_ids array<string>, certainty string, actor_id string, recorded_at timestamp",
    )
    assert store.append_events(C.supersede(store.read(), fix)) == 0
    gone = spark.createDataFrame([("e2", "n3", "wrong", "ann", LATER), ("e3", "n4", " ", "ann", LATER)], "event_id string, new_id string, reason string, actor_id string, recorded_at timestamp")
    assert store.append_events(C.retract(store.read(), gone)) == 1
    assert [r.reason_code for r in store.quarantine.read().collect()] == ["no_reason"]
    assert {r.id for r in E.current_events(store.read()).collect()} == {"n1", "n3", "e3"}
    assert {r.id for r in store.read().collect()} == {"e1", "e2", "e3", "n1", "n3"}
    assert store.chain_breaks().count() == 0


def test_rejections_need_a_reason_and_a_proposal(spark):
    proposals = spark.createDataFrame([("p1",), ("p2",)], "id string")
    said = spark.createDataFrame([("p1", "no source", "bo", LATER), ("p2", "", "bo", LATER), ("p2", None, "bo", LATER), ("p9", "x", "bo", LATER)], "proposal_id string, reason string, actor_id string, recorded_at timestamp")
    assert [(r.proposal_id, r.status) for r in C.reject(proposals, said).collect()] == [("p1", "rejected")]


def test_moves_by_hand_are_proposals(spark):
    moves = spark.createDataFrame([("p1", "d1", "Won", "asked", "ann", LATER), ("p2", "d1", "Nowhere", None, "ann", LATER)], "id string, deal_id string, stage string, reason string, actor_id string, moved_at timestamp")
    (row,) = C.propose_stage(moves).collect()
    assert (row.id, row.event_type, row.payload, row.created_by) == ("p1", "DealStageChanged", '{"deal_id":"d1","stage":"Won","reason":"asked"}', "ann")


def test_rebuild_gives_equal_hashes(spark):
    rows = [event(k, stream_id=f"s{k % 3}") for k in range(1, 12)]
    views = {"state": (["stream_id"], ["id", "payload"]), "kinds": (["event_type"], ["id"])}
    made = [C.rebuild(frame(spark, r), views, ("recorded_at", "id")) for r in (rows, rows[::-1])]
    for name in views:
        assert E.frame_hash(made[0][name]).collect() == E.frame_hash(made[1][name]).collect()


def test_a_second_run_adds_nothing(spark):
    found = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h3")], "source_key string, content_hash string")
    empty = found.limit(0)
    count = lambda have: {r.source_key: (r.documents, r.added) for r in C.run_counts(found, have).collect()}
    assert count(empty) == {"a": (2, 2), "b": (1, 1)}
    assert count(found) == {"a": (2, 0), "b": (1, 0)}
