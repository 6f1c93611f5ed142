"""Two writers, repeated ids, dead writers, and an index that reads no more as it grows."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from annalist import model
from annalist.sources import commits, runs
from annalist.sources import store as St
from tests.test_desk import event, frame


def _keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string").select(runs.key_of(F.col("name")).alias("key"), "name")


def test_two_writers_at_once_make_one_chain(spark, tmp_path):
    errors, began = [], threading.Barrier(2)

    def write(name):
        store = St.EventStore(spark, str(tmp_path))
        try:
            for k in range(3):
                began.wait(60)
                assert store.append_events(frame(spark, event(k, id=f"{name}{k}"), event(k, id=f"{name}{k}b", stream_id=name))) == 0
        except BaseException as e:  # noqa: BLE001
            errors.append(e)
            began.abort()

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    assert not errors
    store = St.EventStore(spark, str(tmp_path))
    rows = store.read().filter("stream_id = 's1'").orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, 7)) and {r.id for r in rows} == {f"{n}{k}" for n in "ab" for k in range(3)}
    assert store.chain_breaks().count() == 0 and store.cut_ends().count() == 0 and store.read().count() == 12
    assert not os.path.exists(tmp_path / "_scratch") or not os.listdir(tmp_path / "_scratch")
    assert all(not os.listdir(tmp_path / t / "_waiting") for t in ("events", "ids", "stream_heads"))


def test_ids_are_in_the_log_once(spark, tmp_path):
    store = St.EventStore(spark, str(tmp_path))
    batch = frame(spark, event(1), event(2), event(2))
    assert store.append_events(batch) == 0
    assert store.append_events(batch) == 0  # sent again
    assert store.append_events(frame(spark, event(1, payload='{"n": 2}'), event(3), event(3, payload='{"n": 9}', recorded_at=dt.datetime(2025, 1, 1)))) == 2
    assert [(r.id, r.sequence) for r in store.read().orderBy("sequence").collect()] == [("e1", 1), ("e2", 2), ("e3", 3)]
    assert [(r.id, r.reason_code) for r in store.quarantine.read().orderBy("id").collect()] == [("e1", "duplicate_id"), ("e3", "duplicate_id")]
    assert store.chain_breaks().count() == 0 and store.append_events(batch.filter("false")) == 0


def test_a_writer_that_dies_before_its_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    store = St.EventStore(spark, str(tmp_path))
    store.append_events(frame(spark, event(1)))

    def dies(*_):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(commits.Files, "publish", dies)
        m.setattr(commits.CommitLog, "abandon", lambda *_: None)  # nor can it clean up
        with pytest.raises(OSError):
            store.append_events(frame(spark, event(2)))
    other = St.EventStore(spark, str(tmp_path))
    assert [r.id for r in other.read().collect()] == ["e1"]
    assert [r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(store.path).collect()] == ["e1"]
    assert os.listdir(tmp_path / "events" / "_waiting")
    assert other.append_events(frame(spark, event(2))) == 0
    assert other.log.sweep(older_than_s=-60) >= 3 and not os.listdir(tmp_path / "events" / "_waiting")
    assert [r.sequence for r in other.read().orderBy("sequence").collect()] == [1, 2] and other.chain_breaks().count() == 0


def test_a_writer_that_dies_after_its_manifest_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    store = St.EventStore(spark, str(tmp_path))

    def dies(*_):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "_settle", dies)
        m.setattr(commits.CommitLog, "abandon", lambda *_: None)
        with pytest.raises(OSError):
            store.append_events(frame(spark, event(1)))
    other = St.EventStore(spark, str(tmp_path))
    assert [r.id for r in other.read().collect()] == ["e1"]
    assert other.append_events(frame(spark, event(1), event(2))) == 0 and other.read().count() == 2 and other.chain_breaks().count() == 0


def test_a_failure_after_publishing_keeps_the_files(spark, tmp_path, monkeypatch):
    """The commit stands: what it names must not be deleted with the leavings of the failure."""
    store = St.EventStore(spark, str(tmp_path))

    def dies(*_):
        raise OSError("no folder was moved")

    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "_settle", dies)
        with pytest.raises(OSError):
            store.append_events(frame(spark, event(1)))
    assert [r.id for r in St.EventStore(spark, str(tmp_path)).read().collect()] == ["e1"]


def test_snapshots_take_the_place_of_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    log = commits.CommitLog(spark, str(tmp_path))
    for k in range(7):
        now = log.snapshot()
        assert log.commit(now, {"t": [log.stage_rows("t", spark.range(k, k + 1))]}, {"t": [p["id"] for p in now.tables.get("t", [])[:1]]} if k == 5 else None)
    assert not log.commit(commits.Snapshot(3, {}), {})  # long overtaken
    for v in (1, 2, 3):
        os.remove(tmp_path / "_commits" / f"{v:020d}.json")
    (tmp_path / "_snapshots" / f"{9:020d}.json").write_text("{")
    fresh = commits.CommitLog(spark, str(tmp_path))
    assert fresh.snapshot() == log.snapshot() and fresh.snapshot().version == 7
    assert sorted(r.id for r in fresh.read("t", "id long").collect()) == [1, 2, 3, 4, 5, 6]
    assert fresh.sweep(-60) == 1 and sorted(r.id for r in fresh.read("t", "id long").collect()) == [1, 2, 3, 4, 5, 6]


def test_publishing_on_a_file_system_that_is_not_local(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./d", f"file://{tmp_path}")
    files = commits.Files(spark, "viewfs://store/d")
    assert not files.is_local
    assert files.publish("viewfs://store/d/c/1.json", "one") and not files.publish("viewfs://store/d/c/1.json", "two")
    assert files.read("viewfs://store/d/c/1.json") == "one" and list(files.children("viewfs://store/d/c")) == ["1.json"]


def test_found_keys_equal_a_plain_set(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    index = runs.Runs(log, "t", "n long", newest="n", prefix_keys=20, fanout=4)
    plain = {}
    for k in range(9):
        names = [f"k{(37 * k + i) % 400}" for i in range(10 * (k + 1))]
        rows = _keys(spark, names).select("key", F.lit(k).cast("long").alias("n"))
        plain |= dict.fromkeys(names, k)
        now = log.snapshot()
        assert log.commit(now, {"t": [index.stage(rows, len(names))]})
        index.merge()
    now = log.snapshot()
    assert max(r["depth"] for r in now.tables["t"]) >= 1 and len(now.tables["t"]) < 9
    asked = _keys(spark, [f"k{i}" for i in range(600)])
    found = {r.name: r.n for r in index.find(asked, now).join(asked, "key").collect()}
    assert found == plain
    assert index.find(asked.filter("false"), now).count() == 0 and {r.n for r in index.all(now).collect()} <= set(range(9)) and index.all(now).count() == len(plain)


def test_a_lookup_reads_no_more_of_a_larger_index(spark, tmp_path):
    """Ten new keys: filters of ten prefixes at most are read, and no keys, whatever the size. A key that is there opens its prefix alone."""
    read = []
    for size in (1_000, 5_000):
        log = commits.CommitLog(spark, str(tmp_path / str(size)))
        index = runs.Runs(log, "t", prefix_keys=100)
        rows = spark.range(size).select(runs.key_of(F.col("id")).alias("key"))
        assert log.commit(log.snapshot(), {"t": [index.stage(rows, size)]})
        now = log.snapshot()
        assert index.find(_keys(spark, [f"new{i}" for i in range(10)]), now).count() == 0
        read.append((index.reads.filters, index.reads.keys))
        assert index.reads.prefixes >= size / 100
        one = spark.range(7, 8).select(runs.key_of(F.col("id")).alias("key"))
        assert index.find(one, now).count() == 1 and (index.reads.filters, index.reads.keys) == (1, 1)
        # what was not to be read is not needed either
        keep = one.select(F.hex("key")).first()[0]
        folder = f"{log.folder('t', now.tables['t'][0]['id'])}/keys"
        for name in os.listdir(folder):
            if name.startswith("prefix=") and not keep.startswith(name.removeprefix("prefix=p")):
                for f in os.listdir(f"{folder}/{name}"):
                    os.remove(f"{folder}/{name}/{f}")
        assert index.find(one, now).count() == 1
    assert read[1][0] <= 10 and read[1][1] <= 1
