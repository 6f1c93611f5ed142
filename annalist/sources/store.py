"""Append-only Parquet stores, and the governed event store.

Files of a table can be overwritten by whoever may write its folder; this library never does it, and the hash chain shows it.
"""

from __future__ import annotations

import random
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist import model
from annalist.functions import text as X
from annalist.functions.geo import shape
from annalist.functions.schema import violation_by
from annalist.operators import documents as D
from annalist.operators import events as E
from annalist.operators import govern as G
from annalist.sources.commits import CommitLog, Snapshot
from annalist.sources.runs import PREFIX_KEYS, Runs, key_of

CONTENT = (
    "id", "stream_type", "stream_id", "sequence", "event_type", "payload", "evidence_text", "certainty", "actor_type", "actor_id", "model_id", "prompt_version",
    "proposal_id", "brief_version_id", "supersedes_event_id", "recorded_text",
)


class AppendOnly:
    """A folder that only grows."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # a store that nothing was written to yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def append(self, rows: DataFrame) -> None:
        names = [f.name for f in self.schema.fields]
        have = set(rows.columns)
        rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]).select(*names).write.mode("append").parquet(self.path)

    def overwrite(self, *_) -> None:
        raise PermissionError("the store is append-only: correct by superseding")

    update = delete = truncate = overwrite


class KeyedTable(AppendOnly):
    """An append-only table whose rows are told apart by ``keys``: a row whose key is there adds nothing.

    Keys are looked up in an index that is published with the rows in one commit, so several writers may add at once, a batch may
    be sent again, and adding reads of the table what may hold the keys of the batch alone.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], prefix_keys: int = PREFIX_KEYS):
        super().__init__(spark, path, schema)
        self.keys = list(keys)
        self.log = CommitLog(spark, path)
        self.index = Runs(self.log, "keys", prefix_keys=prefix_keys)

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.log.read("rows", self.schema, snapshot)

    def _key(self) -> Column:
        return key_of(*[F.col(c) for c in self.keys])

    def unseen(self, rows: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows whose key is not in the table (yet)."""
        now = snapshot or self.log.snapshot()
        keyed = rows.withColumn("__key", self._key())
        seen = self.index.find(keyed.select(F.col("__key").alias("key")).distinct(), now)
        return keyed.join(seen.select(F.col("key").alias("__key")), "__key", "left_anti").drop("__key")

    def append(self, rows: DataFrame) -> None:
        self.add(rows)

    def add(self, rows: DataFrame, attempts: int = 20) -> int:
        """Append the rows with new keys, one row for each key (callers choose which by giving one); returns how many."""
        have = set(rows.columns)
        rows = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        scratch = self.log.scratch()
        try:
            rows.withColumn("key", self._key()).dropDuplicates(["key"]).write.parquet(f"{scratch}/rows")
            given = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])).parquet(f"{scratch}/rows")
            for k in range(attempts):
                now = self.log.snapshot()
                new = given
                if now.tables.get("keys"):
                    given.join(self.index.find(given.select("key"), now).select("key"), "key", "left_anti").write.parquet(f"{scratch}/new{k}")
                    new = self.spark.read.schema(given.schema).parquet(f"{scratch}/new{k}")
                if not (n := new.count()):
                    return 0
                staged: dict[str, list[dict]] = {"rows": [], "keys": []}
                try:
                    staged["rows"].append(self.log.stage_rows("rows", new.select(*rows.columns), rows=n))
                    staged["keys"].append(self.index.stage(new, n))
                except BaseException:
                    self.log.abandon(staged)
                    raise
                if self.log.commit(now, staged):
                    self.index.merge()
                    return n
                self.log.abandon(staged)
                time.sleep(random.random() * 0.2)
            raise RuntimeError(f"other writers were faster {attempts} times")
        finally:
            self.log.files.delete(scratch)


def event_content():
    return E.canonical(*CONTENT)


def _texts() -> dict[str, Column]:
    return {"evidence_text": F.to_json("evidence_ids"), "recorded_text": F.unix_micros("recorded_at").cast("string")}


def _hashed(events: DataFrame) -> DataFrame:
    return events.withColumns(_texts())


#: The content of an event without what the store gives it.
SENT = tuple(c for c in CONTENT if c != "sequence")


class EventStore(AppendOnly):
    """The event log: validated, numbered, chained, and written in commits that several writers may try at once.

    An append stages its rows, looks up its ids and the heads of its streams in two indexes (:mod:`annalist.sources.runs`), and
    publishes rows, ids and heads in one commit (:mod:`annalist.sources.commits`). If another writer was faster, it abandons
    its files, reads the new heads and tries again: so numbers and hashes of a stream follow one another whoever writes, an id
    is in the log once, and what a reader sees is whole commits. The log itself is never read by an append.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, Mapping] | None = None):
        """``schemas``: JSON Schemas of payloads by event type; a payload that breaks its own is refused, and the reason names the path."""
        super().__init__(spark, path + "/events", model.EVENT)
        self.schemas = dict(schemas or {})
        self.quarantine = AppendOnly(spark, path + "/quarantine", model.QUARANTINE)
        self.head_log = AppendOnly(spark, path + "/heads", model.HEAD)
        self.log = CommitLog(spark, path)
        self.ids = Runs(self.log, "ids", "content string")
        self.ends = Runs(self.log, "stream_heads", "stream_type string, stream_id string, head bigint, hash string", newest="head")

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.log.read("events", self.schema, snapshot)

    def heads(self) -> DataFrame:
        """The last number and hash of each stream."""
        return self.ends.all(self.log.snapshot()).drop("key")

    def repair_heads(self) -> None:
        """Compare the heads with the log, which is read once, and add those that differ."""
        now = self.log.snapshot()
        ends = self.read(now).groupBy(*E.STREAM).agg(F.max("sequence").alias("head"), F.max_by("hash", "sequence").alias("hash"))
        wrong = ends.join(self.ends.all(now).select(*E.STREAM, "head"), [*E.STREAM, "head"], "left_anti").withColumn("key", key_of(F.col("stream_type"), F.col("stream_id")))
        if n := wrong.count():
            self.log.commit(now, {"stream_heads": [self.ends.stage(wrong, n)]})

    def append_events(self, rows: DataFrame, attempts: int = 20) -> int:
        """Append what passes the rules; the rest goes to quarantine with its reason. Returns how many rows were refused.

        An event whose id is in the log already, or is repeated in ``rows``, is skipped if it says the same, so a batch may be
        sent again; one that says something else is refused (``duplicate_id``; within ``rows``, the first by time and content
        stays). ``attempts``: how often other writers may be faster before this gives up.
        """
        have = set(rows.columns)
        rows = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.EVENT.fields if f.name not in ("sequence", "prev_hash", "hash")])
        reason = F.coalesce(E.reason_code(required=("id", "stream_id", "recorded_at")), F.concat(F.lit("schema "), violation_by(F.col("event_type"), F.col("payload"), self.schemas)))
        scratch = self.log.scratch()
        try:
            judged = self._kept(_hashed(rows.withColumn("reason_code", reason)).withColumns({"content": F.sha2(E.canonical(*SENT), 256), "key": key_of(F.col("id"))}).select(*rows.columns, "reason_code", "content", "key"), f"{scratch}/judged")
            good, twice = self._once(judged.filter(F.col("reason_code").isNull()).drop("reason_code"), scratch)
            refused = judged.filter(F.col("reason_code").isNotNull()).select(*rows.columns, "reason_code")
            refused = refused.unionByName(twice.select(*rows.columns, F.lit("duplicate_id").alias("reason_code")))
            for _ in range(attempts):
                now = self.log.snapshot()
                new, other = self._unseen(good, now, f"{scratch}/{now.version}")
                if self._commit(new, now, f"{scratch}/{now.version}"):
                    break
                time.sleep(random.random() * 0.2)
            else:
                raise RuntimeError(f"other writers were faster {attempts} times")
            refused = refused.unionByName(other.select(*rows.columns, F.lit("duplicate_id").alias("reason_code")))
            if n := refused.count():
                self.quarantine.append(refused.select("id", F.lit("append").alias("step"), F.to_json(F.struct("event_type", "payload")).alias("output"), "reason_code", F.col("recorded_at").alias("created_at")))
        finally:
            self.log.files.delete(scratch)
        self.ids.merge()
        self.ends.merge()
        return n

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _once(self, good: DataFrame, scratch: str) -> tuple[DataFrame, DataFrame]:
        """One event of each id, and those that say something else under the id of another. Only rows whose id may come again (by 64
        bits of its key) are compared; the others are not shuffled."""
        twin = F.xxhash64("key")
        again = self._kept(good.groupBy(twin.alias("twin")).count().filter("count > 1").select("twin"), f"{scratch}/again")
        if again.isEmpty():
            return good, good.filter("false")
        several = good.join(again, twin == F.col("twin"), "left_semi").dropDuplicates(["key", "content"])
        first = several.groupBy("key").agg(F.min(F.struct("recorded_at", "content"))["content"].alias("first"))
        several = self._kept(several.join(first, "key"), f"{scratch}/several")
        once = good.join(again, twin == F.col("twin"), "left_anti").unionByName(several.filter("content = first").drop("first"))
        return self._kept(once, f"{scratch}/once"), several.filter("content <> first").drop("first")

    def _unseen(self, good: DataFrame, now: Snapshot, scratch: str) -> tuple[DataFrame, DataFrame]:
        """Events whose id the log does not have, and those whose id it has with another content."""
        if not now.tables.get("ids"):
            return good, good.filter("false")
        seen = self._kept(self.ids.find(good.select("key"), now).withColumnRenamed("content", "before"), f"{scratch}/seen")
        if seen.isEmpty():
            return good, good.filter("false")
        told = self._kept(good.join(seen, "key", "left").filter("before IS NULL OR content <> before"), f"{scratch}/told")
        return told.filter("before IS NULL").drop("before"), told.filter("before IS NOT NULL").drop("before")

    def _commit(self, new: DataFrame, now: Snapshot, scratch: str) -> bool:
        heads = None
        if now.tables.get("stream_heads"):
            streams = self._kept(new.select(*E.STREAM).distinct().withColumn("key", key_of(F.col("stream_type"), F.col("stream_id"))), f"{scratch}/streams")
            heads = self.ends.find(streams, now)
        staged: dict[str, list[dict]] = {"events": [], "ids": [], "stream_heads": []}
        try:
            chained = E.extend_chain(new.drop("key", "content"), E.canonical(*[_texts().get(c, c) for c in CONTENT]), heads)
            events = self.log.stage_rows("events", chained.select(*[f.name for f in model.EVENT.fields]))
            staged["events"].append(events)
            ends = self.log.read_staged("events", self.schema, events).groupBy(*E.STREAM).agg(F.max("sequence").alias("head"), F.max_by("hash", "sequence").alias("hash"), F.count(F.lit(1)).alias("n"))
            ends = self._kept(ends.withColumn("key", key_of(F.col("stream_type"), F.col("stream_id"))), f"{scratch}/ends")
            events["rows"], n_streams = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
            if not events["rows"]:
                self.log.abandon(staged)
                return True
            staged["ids"].append(self.ids.stage(new, events["rows"]))
            staged["stream_heads"].append(self.ends.stage(ends, n_streams))
        except BaseException:
            self.log.abandon(staged)
            raise
        if self.log.commit(now, staged):  # if this fails, it may be published all the same: then its files must stay
            return True
        self.log.abandon(staged)
        return False

    def cut_ends(self) -> DataFrame:
        """Streams whose last event is gone from the log."""
        return E.cut_ends(self.read(), self.heads())

    def chain_breaks(self) -> DataFrame:
        return E.chain_breaks(_hashed(self.read()), event_content())

    def state(self, keys: list[str], values: list[str], at=None) -> DataFrame:
        """Current values, or those at a time: the cut comes before supersession and fold."""
        events = self.read() if at is None else E.as_of(self.read(), at)
        return E.project_state(E.current_events(events), keys, ["recorded_at", "sequence", "id"], values)


def tables(spark: SparkSession, path: str) -> dict[str, AppendOnly]:
    """The other append-only tables of a store, by name."""
    schemas = {
        "texts": model.TEXT, "evidence": model.EVIDENCE, "proposals": model.PROPOSAL, "model_calls": model.MODEL_CALL, "security_log": model.SECURITY_LOG,
        "collector_runs": model.COLLECTOR_RUN,
    }
    keyed = {
        "sources": KeyedTable(spark, f"{path}/sources", model.SOURCE, ["content_hash"]),
        "source_urls": KeyedTable(spark, f"{path}/source_urls", model.SOURCE_URL, ["source_id", "url"]),
        "entities": KeyedTable(spark, f"{path}/entities", model.ENTITY, ["id"]),
    }
    return {name: AppendOnly(spark, f"{path}/{name}", schema) for name, schema in schemas.items()} | keyed


def write_sources(sources: KeyedTable, urls: KeyedTable, found: DataFrame, licences: Mapping[str, str], brief_version_id: str | None = None) -> None:
    """Append found documents (url, text, fetched_at, licence_code, ... columns of a source) as sources.

    A text is one source, the first found of it: with its hash, fingerprint, language and retention policy, and an id that its
    hash gives. A text that is there already adds none; every address that it was found at is kept once. So found documents may
    be written again after a failure. The tables are not read for that, only their indexes of keys.
    """
    rows = found.withColumn("content_hash", X.content_hash(X.normalise(F.col("text")))).withColumn("id", X.ulid_like(F.lit("source"), F.col("content_hash")))
    new = sources.unseen(E.first_of(rows, ["content_hash"], ["fetched_at", "url"]))
    judged = D.with_policy(new, licences, "licence_code").withColumns({"language": X.detect_language(F.col("text")), "brief_version_id": F.lit(brief_version_id)})
    sources.append(judged.join(D.simhash(new, "content_hash", "text"), "content_hash"))
    seen = rows.groupBy(F.col("id").alias("source_id"), "url").agg(F.min("fetched_at").alias("seen_at"))
    urls.append(seen)


def purge_texts(texts: DataFrame, sources: DataFrame, now: Column, days: int, target: str) -> None:
    """Write the texts (source_id, text, ...) to a new folder, those that have expired as null: their rows and hashes stay."""
    policy = sources.select(F.col("id").alias("source_id"), F.col("retention_policy"), F.col("fetched_at"))
    kept = G.expire_texts(texts.join(policy, "source_id", "left"), now, days)
    kept.select(*texts.columns).write.parquet(target)


def write_texts(texts: AppendOnly, rows: DataFrame) -> None:
    """Append normalised texts (source_id, text_uri, text) with their hashes; a source whose text is there already adds none."""
    new = rows.join(texts.read().select("source_id").distinct(), "source_id", "left_anti").dropDuplicates(["source_id"])
    text = X.normalise(F.col("text"))
    texts.append(new.withColumn("text", text).withColumn("content_hash", X.content_hash(F.col("text"))))


def write_evidence(evidence: AppendOnly, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Append evidence (id, source_id, char_start, char_end, quote) with its hash and whether the text holds it; returns the rows."""
    judged = D.verify_spans(rows.withColumn("quote_hash", X.content_hash(F.col("quote"))), texts)
    evidence.append(judged)
    return judged


def entity_reason() -> Column:
    """Why an entity may not be written, null if it may: the first rule that it breaks.

    Its type is known; a site class is known and belongs to a site; watch is known or null; a place has both lon and lat within
    their ranges, or neither and a well-known text that can be read, and names its evidence, as no place is invented.
    """
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    lon, lat, wkt = F.col("geometry.lon"), F.col("geometry.lat"), F.col("geometry.wkt")
    inside = F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))
    return (
        F.when(F.col("id").isNull(), "missing_value")
        .when(~known("type", model.ENTITY_TYPES), "unknown_type")
        .when(F.col("site_class").isNotNull() & ~known("site_class", model.SITE_CLASSES), "unknown_site_class")
        .when(F.col("site_class").isNotNull() & (F.col("type") != "site"), "class_without_site")
        .when(F.col("watch").isNotNull() & ~known("watch", model.WATCH), "unknown_watch")
        .when(F.col("geometry").isNotNull() & (lon.isNotNull() | lat.isNotNull() | wkt.isNull()) & ~inside, "bad_point")
        .when(wkt.isNotNull() & shape(wkt).isNull(), "bad_shape")
        .when(F.col("geometry").isNotNull() & F.col("geometry.evidence_id").isNull(), "place_without_evidence")
    )


def write_entities(entities: KeyedTable, quarantine: AppendOnly, rows: DataFrame, at: Column) -> int:
    """Add the entities that keep the rules (:func:`entity_reason`) and whose id is new; the others go to quarantine with their
    reason and the time ``at``. Of rows with one id, one is added. Returns how many were added."""
    judged = rows.withColumn("reason_code", entity_reason())
    bad = judged.filter(F.col("reason_code").isNotNull())
    quarantine.append(bad.select("id", F.lit("entity").alias("step"), F.to_json(F.struct("type", "site_class", "watch", "geometry")).alias("output"), "reason_code", at.alias("created_at")))
    return entities.add(judged.filter(F.col("reason_code").isNull()))


def log_security(log: AppendOnly, actions: DataFrame) -> None:
    """Append sign-ins, role changes, erasures, ... (ts, user_id, action, detail): apart from the event log."""
    log.append(actions)


def write_raw(files: DataFrame, path: str) -> None:
    """Raw documents (path, modificationTime, length, content: the binaryFile format) for keeping."""
    files.write.mode("append").parquet(path)


def register_manual(rows: DataFrame) -> DataFrame:
    return rows.withColumn("type", F.lit("manual"))


def dead_letter(runs: DataFrame, most: int = 3) -> DataFrame:
    """Fetches that failed after all their retries."""
    return runs.filter(~F.col("ok") & (F.col("attempts") > most))


def load_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Site coordinates (JSON lines: site_id, kind, lon, lat, wkt, approximate, evidence_id)."""
    return spark.read.schema("site_id string, kind string, lon double, lat double, wkt string, approximate boolean, evidence_id string").json(path)


def shaped(points: DataFrame) -> DataFrame:
    """Site coordinates of which lon and lat are those of their well-known text (the centre of an area) where they have one that can be
    read; the others stay as they are. ``approximate`` stays: an area's centre is as good as the area."""
    found = shape(F.col("wkt"))
    return points.withColumn("__shape", found).withColumns({c: F.coalesce(F.col(f"__shape.{c}"), F.col(c)) for c in ("kind", "lon", "lat")}).drop("__shape")


def site_point(sites: DataFrame, points: DataFrame, districts: DataFrame) -> DataFrame:
    """A point for each site: its own, else its district's centroid marked approximate, else none. Nothing is invented."""
    own = points.select("site_id", F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
    joined = sites.join(own, "site_id", "left").join(districts.select("district", F.col("lon").alias("__dlon"), F.col("lat").alias("__dlat")), "district", "left")
    return joined.select(
        *sites.columns,
        F.coalesce("__lon", "__dlon").alias("lon"),
        F.coalesce("__lat", "__dlat").alias("lat"),
        F.when(F.coalesce("__lon", "__dlon").isNotNull(), F.col("__lon").isNull()).alias("approximate"),
    )
