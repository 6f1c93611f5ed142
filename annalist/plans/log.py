"""Queries over the event log; the table events stands in for it, one stream for each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import events as E
from annalist.operators import timing as Tm
from annalist.plans.common import STAGE_SQL, staged, table

AT = "2024-01-15 00:00:00"
ORDER = ("ts", "event_id")
CONTENT = ("event_id", "event_type", "props")


def asof_state(spark, sf_dir):
    cut = E.as_of(table(spark, sf_dir, "events"), F.lit(AT).cast("timestamp_ntz"), "ts")
    return E.project_state(cut, ["user_id"], ORDER, ["event_type", "value", "event_id"])


def known_at(spark, sf_dir):
    cut = E.as_of(table(spark, sf_dir, "events"), F.lit(AT).cast("timestamp_ntz"), "ts")
    return cut.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.min("event_id").alias("first_id"))


def _superseding(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(E.W.partitionBy("user_id").orderBy(*ORDER))
    return rows.withColumn("supersedes", F.when(F.col("event_type") == "error", before))


def superseded_current(spark, sf_dir):
    current = E.current_events(_superseding(spark, sf_dir), "event_id", "supersedes")
    return current.select("event_id", "user_id", "event_type")


def stream_sequence(spark, sf_dir):
    return E.assign_sequence(table(spark, sf_dir, "events"), ["user_id"], ORDER).select("event_id", "user_id", "sequence")


def hash_chain(spark, sf_dir):
    rows = E.assign_sequence(table(spark, sf_dir, "events"), ["user_id"], ORDER)
    return E.hash_chain(rows, E.canonical(*CONTENT), ["user_id"]).select("event_id", "user_id", "sequence", "prev_hash", "hash")


def chain_breaks(spark, sf_dir):
    """Every seventh event of a stream is altered after chaining; the breaks are those events."""
    rows = E.assign_sequence(table(spark, sf_dir, "events"), ["user_id"], ORDER)
    chained = E.hash_chain(rows, E.canonical(*CONTENT), ["user_id"])
    altered = chained.withColumn("props", F.when(F.col("sequence") % 7 == 0, F.lit("altered")).otherwise(F.col("props")))
    return E.chain_breaks(altered, E.canonical(*CONTENT), ["user_id"]).select("event_id", "user_id", "sequence", "link_ok", "hash_ok")


def event_checks(spark, sf_dir):
    """An even k of the properties stands for an event without evidence, an error for one that needs a human actor."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "ContactAdded").when(F.col("event_type") == "purchase", "ClaimRetracted").otherwise("SignalScored").alias("event_type"),
        F.lit("entity").alias("stream_type"),
        F.col("props").alias("payload"),
        F.when(k % 2 == 1, F.array(k.cast("string"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(k % 3 == 0, "human").otherwise("system").alias("actor_type"),
        F.lit(None).cast("string").alias("proposal_id"),
    )
    return rows.withColumn("reason_code", E.reason_code()).select("event_id", "reason_code")


def stage_spans(spark, sf_dir):
    return E.spans(table(spark, sf_dir, "events"), ["user_id"], ORDER, "ts").select("event_id", "user_id", "event_type", "valid_from", "valid_to")


def _intervals(spark, sf_dir):
    return Tm.stage_intervals(staged(spark, sf_dir), "user_id", ORDER, "stage", "ts")


def stage_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).groupBy("user_id", "from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"), F.sum("days").alias("days"))


def interval_stats(spark, sf_dir):
    return Tm.interval_stats(_intervals(spark, sf_dir), "user_id")


def window_entry(spark, sf_dir):
    return Tm.window_entry(staged(spark, sf_dir), "user_id", ORDER, "stage").select("event_id", "user_id", "stage")


def first_trace(spark, sf_dir):
    return E.first_of(table(spark, sf_dir, "events"), ["user_id"], ORDER).select("user_id", "event_id", "event_type")


def status_changes(spark, sf_dir):
    return E.changes(table(spark, sf_dir, "events"), ["user_id"], ORDER, "event_type").select("event_id", "user_id", F.col("before").alias("from_type"), F.col("event_type").alias("to_type"))


def forecast_calendar(spark, sf_dir):
    rows = staged(spark, sf_dir)
    stats = Tm.interval_stats(Tm.stage_intervals(rows, "user_id", ORDER, "stage", "ts"), "user_id")
    now = E.project_state(rows, ["user_id"], ORDER, ["stage", "ts"])
    due = Tm.calendar(Tm.forecast(now, stats, "stage", "ts"), F.lit("2024-01-01").cast("date"), date="middle")
    return due.select("user_id", "stage", "to_stage", "earliest", "middle", "latest", "projects")


def forecast_shift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shifted = Tm.forecast_shift(orders, "o_custkey", ["o_orderkey"], "o_orderdate")
    return shifted.select("o_orderkey", "o_custkey")


def latest_action(spark, sf_dir):
    return E.latest_of(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def lead_time_backtest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    signals = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("at"))
    return Tm.backtest(Tm.first_signal(urgent, signals, "o_custkey", "at"), "at")


def due_today(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("local", Tm.local_time(F.col("ts")))
    cadence = F.when(F.col("event_type") == "view", "daily").when(F.col("event_type") == "click", "weekly").otherwise("none")
    return rows.withColumn("due", Tm.due(F.col("local"), cadence)).groupBy(F.col("local").cast("date").alias("day"), "due").agg(F.count(F.lit(1)).alias("n"))


def frame_hash(spark, sf_dir):
    return E.frame_hash(E.project_state(table(spark, sf_dir, "events"), ["user_id"], ORDER, ["event_type", "value"]))


QUERIES = {f.__name__: f for f in (
    asof_state, known_at, superseded_current, stream_sequence, hash_chain, chain_breaks, event_checks, stage_spans, stage_intervals, interval_stats, window_entry,
    first_trace, status_changes, forecast_calendar, forecast_shift, latest_action, lead_time_backtest, due_today, frame_hash,
)}

_CHAIN = """
    WITH RECURSIVE e AS (
        SELECT event_id, user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
            '"' || event_id || '"|"' || event_type || '"|"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"' AS content
        FROM events
    ), c AS (
        SELECT event_id, user_id, sequence, props, content, '' AS prev_hash, sha256('|' || content) AS hash FROM e WHERE sequence = 1
        UNION ALL
        SELECT e.event_id, e.user_id, e.sequence, e.props, e.content, c.hash, sha256(c.hash || '|' || e.content)
        FROM c JOIN e ON e.user_id = c.user_id AND e.sequence = c.sequence + 1
    )
"""
_INTERVALS = f"""
    WITH s AS (SELECT user_id, ts, event_id, {STAGE_SQL} AS stage FROM events),
    i AS (
        SELECT * FROM (
            SELECT user_id, stage AS from_stage, lead(stage) OVER w AS to_stage, ts AS started, date_diff('day', CAST(ts AS DATE), CAST(lead(ts) OVER w AS DATE)) AS days
            FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
        ) WHERE to_stage IS NOT NULL
    ), st AS (
        SELECT from_stage, to_stage, median(days) AS median_days, min(days) AS min_days, max(days) AS max_days, count(DISTINCT user_id) AS projects,
            count(DISTINCT user_id) >= 5 AS supported
        FROM i GROUP BY ALL
    )
"""
SQL = {
    "asof_state": f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id",
    "known_at": f"SELECT event_type, count(*) AS n, max(event_id) AS last_id, min(event_id) AS first_id FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY event_type",
    "superseded_current": """
        WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS gone FROM events)
        SELECT event_id, user_id, event_type FROM s WHERE event_id NOT IN (SELECT gone FROM s WHERE gone IS NOT NULL)
    """,
    "stream_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events",
    "hash_chain": _CHAIN + "SELECT event_id, user_id, sequence, prev_hash, hash FROM c",
    "chain_breaks": _CHAIN + "SELECT event_id, user_id, sequence, true AS link_ok, false AS hash_ok FROM c WHERE sequence % 7 = 0",
    "event_checks": """
        SELECT event_id, CASE
            WHEN event_type NOT IN ('error', 'purchase') AND k % 2 = 0 THEN 'no_evidence'
            WHEN event_type = 'error' AND k % 3 <> 0 THEN 'actor_not_human'
            WHEN event_type = 'purchase' THEN 'no_reason' END AS reason_code
        FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    """,
    "stage_spans": "SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events",
    "stage_intervals": _INTERVALS + "SELECT user_id, from_stage, to_stage, count(*) AS n, CAST(sum(days) AS BIGINT) AS days FROM i GROUP BY ALL",
    "interval_stats": _INTERVALS + "SELECT * FROM st",
    "window_entry": f"""
        SELECT event_id, user_id, stage FROM (
            SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, {STAGE_SQL} AS stage FROM events)
        ) WHERE stage BETWEEN 4 AND 8 AND NOT coalesce(before BETWEEN 4 AND 8, false)
    """,
    "first_trace": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "status_changes": """
        SELECT event_id, user_id, before AS from_type, event_type AS to_type
        FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type
    """,
    "forecast_calendar": _INTERVALS + """
        , n AS (SELECT user_id, arg_max(stage, (ts, event_id)) AS stage, max(ts) AS ts FROM s GROUP BY user_id)
        SELECT user_id, stage, to_stage, CAST(ts AS DATE) + CAST(min_days AS INT) AS earliest, CAST(ts AS DATE) + CAST(floor(median_days) AS INT) AS middle,
            CAST(ts AS DATE) + CAST(max_days AS INT) AS latest, projects
        FROM n JOIN st ON stage = from_stage AND supported
        WHERE CAST(ts AS DATE) + CAST(floor(median_days) AS INT) >= DATE '2024-01-01' AND CAST(ts AS DATE) + CAST(floor(median_days) AS INT) < DATE '2026-01-01'
    """,
    "forecast_shift": """
        SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
        WHERE before >= o_orderdate + INTERVAL 6 MONTH OR (datesub('month', o_orderdate, before) >= 6)
    """,
    "latest_action": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "lead_time_backtest": """
        WITH f AS (SELECT o_custkey, min(o_orderdate) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
        p AS (SELECT o_orderdate AS d, CASE WHEN s < o_orderdate THEN s END AS s FROM orders LEFT JOIN f USING (o_custkey) WHERE o_orderpriority = '1-URGENT')
        SELECT count(*) AS procurements, count(s) AS hits, count(s) / count(*) AS hit_rate, median(datesub('month', s, d)) AS median_months,
            min(datesub('month', s, d)) AS least_months FROM p
    """,
    "due_today": """
        WITH e AS (SELECT event_type, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Africa/Lusaka' AS l FROM events)
        SELECT CAST(l AS DATE) AS day, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN dayofweek(l) = 1 ELSE false END AS due, count(*) AS n FROM e GROUP BY ALL
    """,
}
