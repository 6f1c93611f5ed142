"""Queries that build stores from the tables and read them back: commits, ids, indexes, decisions, live projections, collection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist import model
from annalist.functions import text as X
from annalist.operators import govern as G
from annalist.plans.common import scratch, table
from annalist.sources import runs as Rn
from annalist.sources import store as St
from annalist.sources.commits import CommitLog
from annalist.streaming import streams

#: Documents of one file of the inbox, about.
FILE_ROWS = 10_000


def _n():
    return F.col("event_id")


def approved_once(spark, sf_dir):
    """Proposals that up to three people decide at different times, with different roles: one event of the first valid approval."""
    events = table(spark, sf_dir, "events")
    user = lambda k: F.concat(F.lit("u"), (k % 10).cast("string"))
    after = lambda k: F.col("ts") + F.make_dt_interval(secs=(_n() % k).cast("decimal(18,6)"))
    proposals = events.select(
        _n().cast("string").alias("id"), F.lit("entity").alias("stream_type"), F.col("user_id").cast("string").alias("stream_id"), F.lit("DealIdentified").alias("event_type"), F.col("props").alias("payload"),
        F.array(F.lit("e")).alias("evidence_ids"), F.lit("stated").alias("certainty"), F.when(_n() % 13 != 0, user(F.col("user_id"))).alias("created_by"),
    )
    said = lambda rows, who, at, *more: rows.select(_n().cast("string").alias("proposal_id"), who.alias("actor_id"), at.alias("recorded_at"), *more)
    approvals = said(events.filter(_n() % 2 == 0), user(_n()), after(7), F.lit(None).cast("string").alias("payload"))
    approvals = approvals.unionByName(said(events.filter(_n() % 3 == 0), user(_n() + 3), after(5), F.lit('{"edited": true}').alias("payload")))
    rejections = said(events.filter(_n() % 5 == 0), user(_n() + 1), after(4), F.when(_n() % 10 == 0, "vague").otherwise(" ").alias("reason"))
    roles = events.select(user(F.col("user_id")).alias("user_id"), F.element_at(F.array(*[F.lit(r) for r in model.ROLES]), (F.col("user_id") % 10 % 4 + 1).cast("int")).alias("role")).distinct()
    return G.settle(proposals, approvals, rejections, roles).select("id", "proposal_id", "actor_id", "payload", "recorded_at")


def _events(rows, payload):
    return rows.select(
        F.concat(F.lit("e"), _n().cast("string")).alias("id"), F.lit("entity").alias("stream_type"), F.col("user_id").cast("string").alias("stream_id"), F.lit("SignalScored").alias("event_type"), payload.alias("payload"),
        F.array(F.lit("x")).alias("evidence_ids"), F.lit("system").alias("actor_type"), F.col("ts").cast("timestamp").alias("recorded_at"),
    )


def duplicate_ids_refused(spark, sf_dir):
    """A log that gets all events, and then every third once more: every sixth with another payload, which is refused."""
    rows = table(spark, sf_dir, "events")
    store = St.EventStore(spark, scratch(spark, "log"))
    store.append_events(_events(rows, F.col("props")))
    store.append_events(_events(rows.filter(_n() % 3 == 0), F.when(_n() % 2 == 0, '{"k": -1}').otherwise(F.col("props"))))
    refused = store.quarantine.read().select("id", F.lit(None).cast("string").alias("stream_id"), F.lit(None).cast("long").alias("sequence"), "reason_code")
    return store.read().select("id", "stream_id", "sequence", F.lit(None).cast("string").alias("reason_code")).unionByName(refused)


def appended_chain(spark, sf_dir):
    """A log that is written in four appends: how many events, streams and heads it has, and no break or cut end."""
    rows = table(spark, sf_dir, "events")
    store = St.EventStore(spark, scratch(spark, "log"))
    for k in range(4):
        store.append_events(_events(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k), F.col("props")))
    counts = store.read().agg(F.count(F.lit(1)).alias("events"), F.count_distinct("stream_id").alias("streams"))
    breaks = store.chain_breaks().agg(F.count(F.lit(1)).alias("breaks"))
    ends = store.cut_ends().agg(F.count(F.lit(1)).alias("cut_ends"))
    heads = store.heads().agg(F.sum("head").alias("heads"))
    return counts.crossJoin(breaks).crossJoin(ends).crossJoin(heads)  # one row each


def indexed_hashes(spark, sf_dir):
    """Documents whose text is that of one with an even id, by an index of the hashes of these."""
    docs = table(spark, sf_dir, "documents").select("doc_id", Rn.key_of(X.content_hash(F.col("text"))).alias("key"))
    log = CommitLog(spark, scratch(spark, "index"))
    index = Rn.Runs(log, "hashes", prefix_keys=4_096)
    known = docs.filter("doc_id % 2 = 0").select("key").distinct()
    log.commit(log.snapshot(), {"hashes": [index.stage(known, known.count())]})
    return docs.join(index.find(docs.select("key").distinct(), log.snapshot()), "key", "left_semi").select("doc_id")


def collected_addresses(spark, sf_dir):
    """Addresses of texts, collected in two runs that overlap: each pair once."""
    docs = table(spark, sf_dir, "documents").select(X.content_hash(F.col("text")).alias("source_id"), F.col("source").alias("url"), F.col("doc_id"))
    urls = St.tables(spark, scratch(spark, "store"))["source_urls"]
    for part in ("doc_id % 3 <> 0", "doc_id % 3 <> 1"):
        urls.add(docs.filter(part).select("source_id", "url"))
    return urls.read().select("source_id", "url")


def ingested_texts(spark, sf_dir):
    """Documents that arrive in two halves, as a stream that keeps each text once. A half has as many files as its rows need."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("url"), F.coalesce("text", F.lit("")).alias("text"), F.timestamp_seconds("doc_id").alias("fetched_at"))
    folder = scratch(spark, "inbox")
    half = max(1, -(-docs.count() // (2 * FILE_ROWS)))
    docs.repartition(2 * half).write.parquet(f"{folder}/in")
    found = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", half).parquet(f"{folder}/in")
    query = streams.ingest_stream(found, f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{folder}/out").select("content_hash")


def live_states(spark, sf_dir):
    """What holds of each user and kind of event, when an error takes back the event before it: by state, from files in no order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        _n().cast("string").alias("id"), "user_id", "event_type", "value", "event_id", F.col("ts").cast("timestamp").alias("recorded_at"),
        F.when(F.col("event_type") == "error", F.lag(_n().cast("string")).over(w)).alias("supersedes_event_id"),
    )
    folder = scratch(spark, "live")
    rows.repartition(3, F.xxhash64("id")).write.parquet(f"{folder}/in")
    query = streams.project_live(streams.event_stream(spark, f"{folder}/in", rows.schema, files_at_once=2), f"{folder}/out", f"{folder}/check", ["user_id"], ["event_type"], ["event_id", "value"], order=("recorded_at", "event_id"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return streams.read_live(spark, f"{folder}/out", ["user_id"], ["event_type"])


def registered_entities(spark, sf_dir):
    """Customers as entities, of which every rule is broken by some, written twice: those in the registry, and why the others are not."""
    k = F.col("c_custkey")
    on = lambda r, value, other: F.when(k % 23 == r, value).otherwise(other)
    site = k % 2 == 0
    geometry = F.struct(
        F.lit("point").alias("kind"), on(5, F.lit(181.0), F.col("c_nationkey").cast("double")).alias("lon"), F.when(k % 23 == 6, F.lit(None).cast("double")).otherwise(F.lit(1.0)).alias("lat"),
        on(7, F.lit("POLYGON ((0 0))"), F.lit(None)).cast("string").alias("wkt"), F.lit(False).alias("approximate"), on(8, F.lit(None), F.lit("e")).cast("string").alias("evidence_id"),
    )
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), on(1, F.lit("thing"), F.when(site, "site").otherwise("organisation")).alias("type"),
        on(2, F.lit("castle"), F.when(site | (k % 23 == 3), "mine")).alias("site_class"), on(4, F.lit("hourly"), F.lit("daily")).alias("watch"),
        F.when(k % 3 == 0, geometry).alias("geometry"), F.create_map(F.lit("registry"), F.col("c_name")).alias("external_ids"),
    )
    folder = scratch(spark, "registry")
    tables, quarantine = St.tables(spark, folder), St.AppendOnly(spark, f"{folder}/quarantine", model.QUARANTINE)
    at = F.lit("2024-01-01").cast("timestamp")
    St.write_entities(tables["entities"], quarantine, rows, at)
    St.write_entities(tables["entities"], quarantine, rows.filter("id % 5 = 0"), at)
    kept = tables["entities"].read().select("id", "type", F.lit(None).cast("string").alias("reason_code"))
    return kept.unionByName(quarantine.read().select("id", F.lit(None).cast("string").alias("type"), "reason_code").distinct())


QUERIES = {f.__name__: f for f in (registered_entities, approved_once, duplicate_ids_refused, appended_chain, indexed_hashes, collected_addresses, ingested_texts, live_states)}

_HASH = "sha256(coalesce(text, ''))"
SQL = {
    "registered_entities": """
        WITH r AS (
            SELECT c_custkey AS k, c_custkey % 23 AS m, c_custkey % 2 = 0 AS site, c_custkey % 3 = 0 AS placed, CASE WHEN c_custkey % 2 = 0 THEN 'site' ELSE 'organisation' END AS type FROM customer
        ), j AS (
            SELECT *, CASE WHEN m = 1 THEN 'unknown_type' WHEN m = 2 THEN 'unknown_site_class' WHEN m = 3 AND NOT site THEN 'class_without_site' WHEN m = 4 THEN 'unknown_watch'
                WHEN placed AND m IN (5, 6) THEN 'bad_point' WHEN placed AND m = 7 THEN 'bad_shape' WHEN placed AND m = 8 THEN 'place_without_evidence' END AS reason_code FROM r
        )
        SELECT CAST(k AS VARCHAR) AS id, CASE WHEN reason_code IS NULL THEN type END AS type, reason_code FROM j
    """,
    "approved_once": """
        WITH s AS (
            SELECT event_id, 'u' || event_id % 10 AS actor, ts + to_seconds(event_id % 7) AS tm, true AS approved, NULL AS edited FROM events WHERE event_id % 2 = 0
            UNION ALL SELECT event_id, 'u' || (event_id + 3) % 10, ts + to_seconds(event_id % 5), true, '{"edited": true}' FROM events WHERE event_id % 3 = 0
            UNION ALL SELECT event_id, 'u' || (event_id + 1) % 10, ts + to_seconds(event_id % 4), false, NULL FROM events WHERE event_id % 10 = 0
        ), r AS (SELECT DISTINCT 'u' || user_id % 10 AS actor FROM events WHERE user_id % 10 % 4 >= 2),
        d AS (
            SELECT s.*, e.props, row_number() OVER (PARTITION BY s.event_id ORDER BY tm, approved, actor, edited NULLS FIRST) AS k
            FROM s JOIN r USING (actor) JOIN events e ON e.event_id = s.event_id WHERE e.event_id % 13 <> 0 AND actor <> 'u' || e.user_id % 10
        )
        SELECT upper(substr(sha256('decided' || chr(31) || event_id), 1, 26)) AS id, CAST(event_id AS VARCHAR) AS proposal_id, actor AS actor_id, coalesce(edited, props) AS payload, tm AS recorded_at FROM d WHERE k = 1 AND approved
    """,
    "duplicate_ids_refused": """
        SELECT 'e' || event_id AS id, CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'e' || event_id) AS sequence, NULL AS reason_code FROM events
        UNION ALL SELECT 'e' || event_id, NULL, NULL, 'duplicate_id' FROM events WHERE event_id % 6 = 0
    """,
    "appended_chain": "SELECT count(*) AS events, count(DISTINCT user_id) AS streams, 0 AS breaks, 0 AS cut_ends, count(*) AS heads FROM events",
    "indexed_hashes": f"SELECT doc_id FROM documents WHERE {_HASH} IN (SELECT {_HASH} FROM documents WHERE doc_id % 2 = 0)",
    "collected_addresses": f"SELECT DISTINCT {_HASH} AS source_id, source AS url FROM documents",
    "ingested_texts": f"SELECT DISTINCT {_HASH} AS content_hash FROM documents",
    "live_states": """
        WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS gone FROM events),
        c AS (SELECT * FROM e WHERE event_id NOT IN (SELECT gone FROM e WHERE gone IS NOT NULL))
        SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM c GROUP BY user_id, event_type
    """,
}
