"""Projections from state, and collection that reads no store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import events as E
from annalist.sources import store as St
from annalist.streaming import streams

SCHEMA = "id string, stream_id string, attribute string, sequence long, v string, supersedes_event_id string, recorded_at timestamp"


def _log(rnd, n):
    """Events of two attributes in three streams, with corrections of corrections and retractions, some of events yet to come."""
    rows, known = [], []
    for k in range(n):
        stream = f"s{rnd.randint(0, 2)}"
        mine = [i for i, s in known if s == stream]
        target = rnd.choice(mine) if mine and rnd.random() < 0.5 else None
        retracts = target is not None and rnd.random() < 0.5
        rows.append((f"e{k}", stream, None if retracts else rnd.choice("ab"), k, None if retracts else f"v{k}", target, dt.datetime(2024, 1, 1, 0, rnd.randint(0, 9))))
        known.append((f"e{k}", stream))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_the_folded_log_after_any_order_of_batches(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = _log(rnd, 60)
    rnd.shuffle(rows)
    inbox, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    keys, order = ["stream_id", "attribute"], ["recorded_at", "sequence", "id"]
    for a, b in ((0, 25), (25, 40), (40, 60)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        # a new query each time: it goes on from the checkpoint
        query = streams.project_live(streams.event_stream(spark, inbox, spark.createDataFrame([], SCHEMA).schema), target, ck, ["stream_id"], ["attribute"], ["v", "id"])
        query.awaitTermination(120)
        assert query.exception() is None
        have = spark.createDataFrame(rows[:b], SCHEMA)
        wanted = E.project_state(E.current_events(have), keys, order, ["v", "id"])
        found = streams.read_live(spark, target, ["stream_id"], ["attribute"]).select(*keys, "v", "id")
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_a_store_is_not_read_to_add_to_it(spark, tmp_path, monkeypatch):
    schema = "url string, text string, fetched_at timestamp, licence_code string"
    at = dt.datetime(2024, 1, 1)
    table = lambda name, keys: St.KeyedTable(spark, str(tmp_path / name), St.tables(spark, str(tmp_path / "x"))[name].schema, keys, prefix_keys=50)
    sources, urls = table("sources", ["content_hash"]), table("source_urls", ["source_id", "url"])
    found = lambda a, b: spark.createDataFrame([(f"u{k}", f"text {k} of the day", at, "open") for k in range(a, b)], schema)
    St.write_sources(sources, urls, found(0, 300), {"open": "full"})
    with monkeypatch.context() as m:
        m.setattr(St.KeyedTable, "read", lambda *_: pytest.fail("the table was read"))
        St.write_sources(sources, urls, found(298, 303), {"open": "full"})
        # five addresses: of sixteen prefixes, at most five have their filters read, and those alone that hold a known one their keys
        assert urls.index.reads.prefixes == 16 and urls.index.reads.filters <= 5 and 1 <= urls.index.reads.keys <= 2
        St.write_sources(sources, urls, found(298, 303), {"open": "full"})
    assert sources.read().count() == 303 and urls.read().count() == 303 and sources.read().select("content_hash").distinct().count() == 303


def test_a_repeated_batch_of_collection_replaces_itself(spark, tmp_path):
    schema = "url string, text string, fetched_at timestamp"
    at = dt.datetime(2024, 1, 1)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("u1", "one", at), ("u2", "two", at)], schema).coalesce(1).write.parquet(inbox)
    for ck in ("a", "b"):  # without its checkpoint the first batch comes again
        streams.ingest_stream(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / ck)).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_one_decision_for_a_proposal(spark, tmp_path):
    from annalist.operators import govern as G

    at = lambda m: dt.datetime(2024, 1, 2, 0, m)
    proposals = spark.createDataFrame(
        [(f"p{k}", "entity", "s1", "DealIdentified", "{}", ["x"], "stated", 0.5, "bot" if k != 5 else None, at(0)) for k in range(7)],
        "id string, stream_type string, stream_id string, event_type string, payload string, evidence_ids array<string>, certainty string, confidence double, created_by string, created_at timestamp",
    )
    roles = spark.createDataFrame([("ann", "approver"), ("bob", "admin"), ("eve", "analyst"), ("bot", "admin"), ("ann", "viewer")], "user_id string, role string")
    approvals = spark.createDataFrame(
        [("p0", "bob", None, at(5)), ("p0", "ann", '{"e": 1}', at(3)), ("p1", "eve", None, at(1)), ("p2", "bot", None, at(1)), ("p3", "ann", None, at(9)), ("p4", "ann", None, at(1)), ("p5", "ann", None, at(1)), ("p6", "ann", None, at(2)), ("none", "ann", None, at(1))],
        "proposal_id string, actor_id string, payload string, recorded_at timestamp",
    )
    rejections = spark.createDataFrame([("p3", "bob", "vague", at(2)), ("p4", "bob", "late", at(2)), ("p6", "bob", " ", at(1)), ("p6", "eve", "no", at(1))], "proposal_id string, actor_id string, reason string, recorded_at timestamp")
    events = G.settle(proposals, approvals, rejections, roles)
    assert {(r.proposal_id, r.actor_id, r.payload) for r in events.collect()} == {("p0", "ann", '{"e": 1}'), ("p4", "ann", "{}"), ("p6", "ann", "{}")}
    store = St.EventStore(spark, str(tmp_path))
    assert store.append_events(events) == 0 and store.append_events(events) == 0
    late = G.settle(proposals, approvals.filter("actor_id = 'bob'"), rejections.filter("false"), roles)  # of another batch
    assert store.append_events(late) == 1 and store.read().count() == 3
    assert {r.reason_code for r in store.quarantine.read().collect()} == {"duplicate_id"}


def test_feeds_as_a_stream_resume_without_repeats(spark, tmp_path):
    from annalist.sources import feeds
    from tests.test_sources import ATOM, RSS

    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        query = feeds.stream_feed(spark, str(inbox)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        return sorted((r.feed, r.title or "", r.error is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (inbox / "a.xml").write_text(RSS)
    first = [("a.xml", "One", False), ("a.xml", "Two", False)]
    assert run() == first and run() == first
    (inbox / "b.xml").write_text("<rss>")
    (inbox / "c.xml").write_text(ATOM)
    assert run() == sorted([*first, ("b.xml", "", True), ("c.xml", "Three", False)])


@pytest.mark.parametrize("seed", [3, 4])
def test_slices_and_chunks_give_the_folded_log_with_few_calls(seed):
    """The processor alone, over plain dictionaries: small slices and chunks, and no call for each row."""
    from pyspark.sql.types import LongType, StructField, StructType

    calls = []

    class State:
        def __init__(self):
            self.d = {}

        def __getattr__(self, name):
            act = {
                "containsKey": self.d.__contains__, "getValue": self.d.get, "updateValue": self.d.__setitem__, "removeKey": self.d.__delitem__, "iterator": lambda: iter(list(self.d.items())),
                "values": lambda: iter(list(self.d.values())), "exists": lambda: bool(self.d), "get": lambda: self.d[()], "update": lambda v: self.d.__setitem__((), v),
            }[name]
            return lambda *args: (calls.append(name), act(*args))[1]

    class Handle:
        def getMapState(self, *_):
            return State()

        getValueState = getMapState

    rnd = random.Random(seed)
    rows = [r for r in _log(rnd, 400) if r[1] == "s1"]
    rnd.shuffle(rows)
    for size, chunk, most in ((7, 3, None), (4_096, 64, 40)):
        live = streams._Live(["stream_id"], StructType([StructField("order0", LongType())]))
        live.SLICE, live.CHUNK = size, chunk
        live.init(Handle())
        said, calls[:] = {}, []
        for batch in (rows[:30], rows[30:90], rows[90:]):
            given = [{"id": r[0], "part": r[2], "supersedes": r[5], "value": r[4], "order0": r[3]} for r in batch]
            said |= {r["part"]: None if r["deleted"] else r["value"] for r in live.handleInputRows(("s1",), iter(given), None)}
        gone = {r[5] for r in rows}
        wanted = {}
        for r in sorted(rows, key=lambda r: r[3]):
            if r[0] not in gone:
                wanted[r[2]] = r[4]
        assert {p: v for p, v in said.items() if p in wanted or v is not None} == wanted and (most is None or len(calls) < most * 3)
