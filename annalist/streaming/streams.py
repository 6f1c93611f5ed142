"""Structured Streaming around the batch functions: collection, projections, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from annalist.functions import text as X
from annalist.operators import events as E
from annalist.operators import govern as G
from annalist.sources import store as S
from annalist.sources.commits import CommitLog
from annalist.sources.runs import Runs, key_of


def ingest_stream(found: DataFrame, store: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Collect documents (url, text, fetched_at) as sources: a text that the store has, or had earlier in the batch, adds none.

    Every batch is written under its number, so a batch that is repeated after a failure replaces its own files. Which texts the
    store has is looked up in an index beside it that knows the batch of each; the store itself is not read.
    """
    log = CommitLog(found.sparkSession, f"{store}/_index")
    index = Runs(log, "texts", "batch bigint")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(X.content_hash(F.col("text")).alias("content_hash"), "url", "text", "fetched_at")
        first = E.first_of(rows, ["content_hash"], ["fetched_at", "url"]).withColumn("key", key_of(F.col("content_hash")))
        while True:
            now = log.snapshot()
            known = index.find(first.select("key"), now)
            fresh = first.join(known.filter(F.col("batch") != epoch).select("key"), "key", "left_anti")
            fresh.drop("key").write.mode("overwrite").parquet(f"{store}/batch={epoch}")
            new = fresh.select("key", F.lit(epoch).cast("long").alias("batch")).join(known.select("key"), "key", "left_anti")
            if not (n := new.count()):
                return
            run = index.stage(new, n)
            if log.commit(now, {"texts": [run]}):
                index.merge()
                return
            log.abandon({"texts": [run]})

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def source_stream(found: DataFrame, sources: S.KeyedTable, urls: S.KeyedTable, licences: Mapping[str, str], checkpoint: str, brief_version_id: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Collect documents as whole source rows: :func:`annalist.sources.store.write_sources` for each batch. A repeated batch adds none."""

    def write(batch: DataFrame, _: int) -> None:
        S.write_sources(sources, urls, batch, licences, brief_version_id)

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int = 64) -> DataFrame:
    """The files of a folder as they come, those of its subfolders too: of an event store, what has been committed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").parquet(path)


def project_stream(events: DataFrame, log: Callable[[], DataFrame], target: str, checkpoint: str, keys: list[str], values: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Keep a projection up to date: the streams that a batch touches are folded again from the log and written as a version.

    A reader takes the newest version of each key: :func:`read_projection`.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        touched = batch.select(*keys).distinct()
        events = log().join(touched, keys, "left_semi")
        state = E.project_state(E.current_events(events), keys, ["recorded_at", "sequence", "id"], values)
        state.write.mode("overwrite").parquet(f"{target}/version={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Live(StatefulProcessor):
    """What holds of one stream: its live events, the ids that were superseded before they came, the last event of each part.

    Each call of the state store is a message between two processes. So events and ids are kept in chunks, rows are taken in
    slices, and a stream costs some calls for each slice, not for each row. No more than a slice's rows and chunks are in memory.
    """

    SLICE, CHUNK = 4_096, 64

    def __init__(self, stream: Sequence[str], order: StructType):
        self.said = Row(*stream, "part", "value", "deleted")
        self.event = StructType([StructField("id", StringType()), StructField("part", StringType()), StructField("value", StringType()), *order.fields])
        self.order = order.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        chunk = StructType([StructField("chunk", LongType())])
        self.live = handle.getMapState("live", chunk, StructType([StructField("events", ArrayType(self.event))]))
        self.gone = handle.getMapState("gone", chunk, StructType([StructField("ids", ArrayType(StringType()))]))
        self.last = handle.getMapState("last", StructType([StructField("part", StringType())]), self.event)
        self.ends = handle.getValueState("ends", StructType([StructField("live", LongType()), StructField("gone", LongType())]))

    @staticmethod
    def _rank(event: Sequence) -> tuple:
        """Order as Spark's: a null comes before every value."""
        return tuple((v is not None, v) for v in event[3:])

    def _add(self, state, end: int, more: list) -> int:
        """Fill the last chunk, which is number ``end``, and add others; the number of the last one then."""
        if more and state.containsKey((end,)):
            more = [*(tuple(x) if isinstance(x, Row) else x for x in state.getValue((end,))[0]), *more]
        for i in range(0, len(more), self.CHUNK):
            state.updateValue((end + i // self.CHUNK,), (more[i : i + self.CHUNK],))
        return end + max(0, len(more) - 1) // self.CHUNK

    def _take(self, rows: list, now: dict, known: bool, ends: list[int]) -> None:
        """Take a slice of rows; ``now``: the last events of the parts that were touched, ``known``: whether there is a state."""

        def touch(part: str) -> None:
            if part not in now:
                now[part] = tuple(self.last.getValue((part,))) if known and self.last.containsKey((part,)) else None

        ids = {r["id"] for r in rows}
        late = {i for chunk in self.gone.values() for i in chunk[0] if i in ids} if known else set()
        fresh, named, met = {}, set(), set()
        for r in rows:
            touch(r["part"])
            if (before := r["supersedes"]) is not None:
                (named if fresh.pop(before, None) is None else met).add(before)
            if r["id"] not in late and r["id"] not in named:
                fresh[r["id"]] = (r["id"], r["part"], r["value"], *[r[c] for c in self.order])
        lost = set()
        if known and (named or met):
            hit = []
            for number, chunk in self.live.iterator():
                left = [tuple(e) for e in chunk[0] if e[0] not in named and e[0] not in met]
                if len(left) < len(chunk[0]):
                    hit.append((number, left))
                    for e in chunk[0]:
                        if e[0] in named or e[0] in met:
                            named.discard(e[0])
                            met.add(e[0])
                            touch(e[1])
                            if now[e[1]] is not None and now[e[1]][0] == e[0]:
                                lost.add(e[1])
            for number, left in hit:
                if left:
                    self.live.updateValue(number, (left,))
                else:
                    self.live.removeKey(number)
        if lost:  # the one before holds again
            now.update(dict.fromkeys(lost))
            for chunk in self.live.values():
                for e in chunk[0]:
                    if e[1] in lost and (now[e[1]] is None or self._rank(e) > self._rank(now[e[1]])):
                        now[e[1]] = tuple(e)
        for e in fresh.values():
            if now[e[1]] is None or self._rank(e) >= self._rank(now[e[1]]):
                now[e[1]] = e
        ends[:] = [self._add(self.live, ends[0], list(fresh.values())), self._add(self.gone, ends[1], sorted(named))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.ends.exists()
        before = list(self.ends.get()) if known else [0, 0]
        ends, now, some, state = [*before], {}, iter(rows), known
        while taken := list(islice(some, self.SLICE)):
            self._take(taken, now, state, ends)
            state = True  # what the slice has written; its parts are in ``now``
        if not known or ends != before:
            self.ends.update(tuple(ends))
        for p, event in now.items():
            if event is not None:
                self.last.updateValue((p,), event)
            elif known and self.last.containsKey((p,)):
                self.last.removeKey((p,))
            yield self.said(*key, p, None if event is None else event[2], event is None)


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def project_live(events: DataFrame, target: str, checkpoint: str, stream: list[str], part: list[str], values: list[str], order: Sequence[str] = ("recorded_at", "sequence", "id"), trigger: dict | None = None) -> StreamingQuery:
    """Keep a projection up to date from its state alone: the log is never read again.

    ``stream``: columns by which events are grouped; an event and what supersedes it must have the same. ``part``: further key
    columns (an attribute, for example). For each stream the state holds the events that nothing supersedes and the ids that
    were superseded before they came, so any order of arrival gives the state that folding the whole log gives
    (:func:`annalist.operators.events.current_events`, then ``project_state``). When the last event of a part is superseded or
    retracted, the one before holds again; a part without any is deleted. What changed is written as a version for each batch:
    :func:`read_live`. The state is in the checkpoint, and a query that is started again goes on from there.
    """
    spark, schema = events.sparkSession, events.schema
    told = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if schema[c].dataType.typeName().startswith("timestamp") else F.col(c)
    rows = events.select(
        *stream,
        "id",
        F.col("supersedes_event_id").alias("supersedes"),
        F.to_json(F.array(*[F.col(c).cast("string") for c in part]) if part else F.array().cast("array<string>")).alias("part"),
        F.to_json(F.struct(*values), _EXACT).alias("value"),
        *[told(c).alias(f"order{i}") for i, c in enumerate(order)],
    )
    ranks = StructType([f for f in rows.schema.fields if f.name.startswith("order")])
    out = StructType([*[schema[c] for c in stream], StructField("part", StringType()), StructField("value", StringType()), StructField("deleted", BooleanType())])
    state = rows.groupBy(*stream).transformWithState(_Live(stream, ranks), out, "Update", "None")
    kept = StructType([StructField(c, schema[c].dataType) for c in values])

    def write(batch: DataFrame, epoch: int) -> None:
        typed = batch.select(*stream, F.from_json("part", "array<string>").alias("__part"), F.from_json("value", kept, _EXACT).alias("__value"), F.col("deleted").alias("__deleted"))
        typed.write.mode("overwrite").parquet(f"{target}/version={epoch}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the query keeps the settings that it starts with
    try:
        return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def read_live(spark: SparkSession, target: str, stream: list[str], part: list[str], part_types: Sequence[str] = ()) -> DataFrame:
    """The newest version of each key of :func:`project_live`, without those that nothing holds of; ``part_types`` are the SQL types of
    the columns of ``part`` (strings by default)."""
    rows = E.latest_of(spark.read.parquet(target), [*stream, "__part"], ["version"]).filter(~F.col("__deleted"))
    named = [F.col("__part")[i].cast(part_types[i] if part_types else "string").alias(c) for i, c in enumerate(part)]
    return rows.select(*stream, *named, "__value.*")


def read_projection(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return E.latest_of(spark.read.parquet(target), keys, ["version"]).drop("version")


def raise_alerts(signals: DataFrame, target: str, checkpoint: str, tier: str = "tier", trigger: dict | None = None, store: S.EventStore | None = None) -> StreamingQuery:
    """Tier 0 signals become unconfirmed alerts as they arrive, ahead of any approval.

    With a ``store``, each also becomes an AlertRaised event of its stream, once: the store skips what it has, by its index of ids.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if store is not None:
            store.append_events(G.alert_events(batch, tier))
        alerts = batch.filter(F.col(tier) == 0).withColumn("status", F.lit("unconfirmed")).withColumn("raised_at", F.current_timestamp())
        alerts.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deliver(rows: DataFrame, channels: dict[str, Callable[[DataFrame], None]], checkpoint: str, trigger: dict | None = None, failures: str | None = None, attempts: int = 3) -> StreamingQuery:
    """Hand every batch to each channel, ``attempts`` times at most; a channel that fails does not stop the others.

    What a channel did not take is kept under ``failures`` (batch=.../channel=..., with the error), to be sent by
    :func:`redeliver`. Without that folder the query fails once all channels had their turn, and the batch is tried again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        failed = {}
        for name, send in channels.items():
            for _ in range(attempts):
                try:
                    send(batch)
                    failed.pop(name, None)
                    break
                except Exception as e:  # noqa: BLE001
                    failed[name] = str(e)
        for name, error in failed.items():
            if failures is None:
                raise RuntimeError(f"batch {epoch}: channels failed: {failed}")
            batch.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{failures}/batch={epoch}/channel={name}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def redeliver(spark: SparkSession, failures: str, channels: dict[str, Callable[[DataFrame], None]], columns: list[str]) -> dict[str, int]:
    """Send what was kept for each channel once more; rows sent, by channel. A channel that fails again raises."""
    kept = spark.read.parquet(failures)
    sent = {}
    for name, send in channels.items():
        rows = kept.filter(F.col("channel") == name).select(*columns)
        sent[name] = rows.count()
        if sent[name]:
            send(rows)
    return sent


def counts_by_window(events: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window, for live telemetry; ``time`` is cast, as watermarks need a timestamp."""
    rows = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return rows.groupBy(F.window("__at", window), kind).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", kind, "n")
