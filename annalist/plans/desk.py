"""Queries over the rules of the log, approvals, corrections and reads in the past; events and customers stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist import model
from annalist.operators import corrections as K
from annalist.operators import events as E
from annalist.operators import evaluate as V
from annalist.operators import govern as G
from annalist.operators import panels as P
from annalist.plans.common import table
from annalist.plans.log import _CHAIN, AT, CONTENT, ORDER

KINDS = ("view", "click", "signup", "purchase", "error", "other")
ROLE_NAMES = (*model.ROLES, "ghost")


def _at():
    return F.lit(AT).cast("timestamp_ntz")


def reason_codes_nulls(spark, sf_dir):
    """Events of which every column is null in turn; none of these may be written."""
    k = F.col("event_id") % 10
    given = lambda n, value: F.when(k != n, value)
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        given(1, F.col("event_id").cast("string")).alias("id"),
        given(2, F.when(F.col("event_id") % 20 >= 10, "ContactAdded").otherwise("SignalScored")).alias("event_type"),
        given(3, F.lit("entity")).alias("stream_type"),
        given(4, F.col("user_id").cast("string")).alias("stream_id"),
        given(5, F.col("props")).alias("payload"),
        given(6, F.array(F.lit("e1"))).alias("evidence_ids"),
        given(7, F.lit("human")).alias("actor_type"),
        given(8, F.col("ts")).alias("recorded_at"),
        F.lit(None).cast("string").alias("proposal_id"),
    )
    return rows.withColumn("reason_code", E.reason_code(required=("id", "stream_id", "recorded_at"))).select("event_id", "reason_code")


def _chained(spark, sf_dir):
    rows = E.assign_sequence(table(spark, sf_dir, "events"), ["user_id"], ORDER)
    return E.hash_chain(rows, E.canonical(*CONTENT), ["user_id"])


def chain_tamper(spark, sf_dir):
    """A chain with hashes and previous hashes made null, content changed under a null, and events taken out."""
    k = F.col("sequence") % 17
    rows = _chained(spark, sf_dir).filter(k != 9)
    rows = rows.withColumn("hash", F.when(k != 5, F.col("hash"))).withColumn("prev_hash", F.when(k != 12, F.col("prev_hash"))).withColumn("props", F.when(k == 12, "altered").otherwise(F.col("props")))
    return E.chain_breaks(rows, E.canonical(*CONTENT), ["user_id"]).select("event_id", "user_id", "sequence", "link_ok", "hash_ok", "sequence_ok")


def cut_ends(spark, sf_dir):
    """The last event of every fifth user is gone; the stored heads show it."""
    rows = _chained(spark, sf_dir)
    heads = rows.groupBy("user_id").agg(F.max("sequence").alias("head"), F.max_by("hash", "sequence").alias("hash"))
    left = rows.join(heads.select("user_id", "head"), "user_id").filter((F.col("user_id") % 5 != 0) | (F.col("sequence") < F.col("head"))).drop("head")
    return E.cut_ends(left, heads, ["user_id"]).select("user_id", "head", "last")


def missing_evidence(spark, sf_dir):
    """Events with none, one unverified and one verified piece of evidence; those with none are listed with a null."""
    from annalist.operators.documents import unverified_facts

    k = F.col("event_id") % 4
    named = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("good"))).when(k == 2, F.array(F.lit("good"), F.lit("bad")))
    events = table(spark, sf_dir, "events").select("event_id", named.alias("evidence_ids"))
    evidence = spark.createDataFrame([("good", True), ("bad", False)], "evidence_id string, verified boolean")
    return unverified_facts(events, evidence, "event_id", "evidence_ids", "evidence_id")


def _proposals(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "EntityIdentified").when(F.col("event_type") == "click", "DemandDriverObserved").when(F.col("event_type") == "signup", "EntityMerged").otherwise("SignalScored")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("entity").alias("stream_type"),
        F.col("user_id").cast("string").alias("stream_id"),
        kind.alias("event_type"),
        F.col("props").alias("payload"),
        F.array(F.lit("e"), F.col("event_id").cast("string")).alias("evidence_ids"),
        F.when(F.col("event_id") % 2 == 0, "stated").otherwise("reported").alias("certainty"),
        (F.col("value") / 100).alias("confidence"),
        F.col("user_id").cast("string").alias("created_by"),
        F.col("ts").alias("created_at"),
    )


def _flat(events):
    return events.withColumn("evidence_ids", F.array_join("evidence_ids", " "))


def approved_events(spark, sf_dir):
    """Every third proposal is approved, every sixth is edited; some by the one who made it, which counts for nothing."""
    proposals = _proposals(spark, sf_dir)
    n = F.col("id").cast("long")
    approvals = proposals.filter(n % 3 == 0).select(F.col("id").alias("proposal_id"), (n % 150).cast("string").alias("actor_id"), F.col("created_at").alias("recorded_at"), F.when(n % 6 == 0, '{"edited": true}').alias("payload"))
    return _flat(G.approve(proposals, approvals)).select("id", "stream_type", "stream_id", "event_type", "payload", "evidence_ids", "certainty", "actor_type", "actor_id", "proposal_id", "recorded_at")


def auto_events(spark, sf_dir):
    """The proposals that the policy lets through, as events of their agents."""
    return _flat(G.auto_approve(_proposals(spark, sf_dir))).select("id", "stream_type", "stream_id", "event_type", "evidence_ids", "certainty", "actor_type", "actor_id", "proposal_id", "recorded_at")


def review_queue(spark, sf_dir):
    """What is left to people, by kind."""
    return G.routed(_proposals(spark, sf_dir)).filter("decision = 'review'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def rejections(spark, sf_dir):
    """Rejections of which some have a blank reason and some name no proposal."""
    n = F.col("id").try_cast("long")
    rows = _proposals(spark, sf_dir).filter(n % 5 == 0)
    given = rows.select(F.when(n % 35 == 0, "none").otherwise(F.col("id")).alias("proposal_id"), F.when(n % 10 == 0, "too vague").otherwise("  ").alias("reason"), F.lit("ann").alias("actor_id"), F.col("created_at").alias("recorded_at"))
    return K.reject(rows, given)


def _log(spark, sf_dir):
    rows = _proposals(spark, sf_dir)
    return rows.select("id", "stream_type", "stream_id", "event_type", "payload", "evidence_ids", "certainty", F.col("created_at").alias("recorded_at"))


def corrected_events(spark, sf_dir):
    log = _log(spark, sf_dir)
    n = F.col("id").try_cast("long")
    given = log.filter(n % 50 == 0).select(F.when(n % 100 == 0, F.col("id")).otherwise("unknown").alias("event_id"), F.concat(F.lit("c"), F.col("id")).alias("new_id"), F.lit("{}").alias("payload"), "evidence_ids", F.lit("stated").alias("certainty"), F.lit("ann").alias("actor_id"), "recorded_at")
    return _flat(K.supersede(log, given))


def retracted_events(spark, sf_dir):
    """The log after its retractions: what was retracted is not current."""
    log = _log(spark, sf_dir).withColumn("supersedes_event_id", F.lit(None).cast("string"))
    given = log.filter(F.col("id").cast("long") % 40 == 0).select(F.col("id").alias("event_id"), F.concat(F.lit("r"), F.col("id")).alias("new_id"), F.lit("withdrawn").alias("reason"), F.lit("ann").alias("actor_id"), "recorded_at")
    gone = K.retract(log, given)
    whole = log.select("id", "event_type", "supersedes_event_id").unionByName(gone.select("id", "event_type", "supersedes_event_id"))
    return E.current_events(whole).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stage_proposals(spark, sf_dir):
    """Moves by hand become proposals; unknown stages do not."""
    stage = F.when(F.col("event_type") == "purchase", "Won").when(F.col("event_type") == "signup", "Qualified").otherwise("Elsewhere")
    moves = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("deal_id"), stage.alias("stage"), F.lit("by phone").alias("reason"), F.lit("ann").alias("actor_id"), F.col("ts").alias("moved_at"))
    return K.propose_stage(moves).select("id", "event_type", "payload", "created_by", "created_at")


def kanban_as_of(spark, sf_dir):
    """Users by the kind of the last event that was known then; a kind without a user counts 0."""
    return P.kanban(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type", KINDS, at=_at(), time="ts")


def watch_list_as_of(spark, sf_dir):
    """Users with the last purchase that was known then."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    reports = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return P.watch_list(users, reports, "user_id", ["ts", "event_id"], at=_at(), time="ts").select("user_id", "event_id")


def timeline_as_of(spark, sf_dir):
    """Two kinds of events as one timeline, up to then."""
    rows = table(spark, sf_dir, "events")
    part = lambda kind: rows.filter(F.col("event_type") == kind).select("user_id", "event_id", F.lit(kind).alias("kind"), "ts")
    return P.timeline(part("purchase"), part("signup"), key="user_id", order=["ts", "event_id"], at=_at(), time="ts").select("user_id", "event_id", "kind", "place")


def role_rights(spark, sf_dir):
    name = lambda n: F.element_at(F.array(*[F.lit(x) for x in ROLE_NAMES]), (n % len(ROLE_NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.coalesce(G.can(name(F.col("event_id")), name(F.col("user_id"))), F.lit(False)).alias("may"))


def visible_statuses(spark, sf_dir):
    sure = F.when(F.col("event_id") % 3 == 0, "stated").when(F.col("event_id") % 3 == 1, "reported").otherwise("speculative")
    alert = F.when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "signup", "unconfirmed").otherwise("confirmed")
    return table(spark, sf_dir, "events").groupBy(G.visible_status(sure, alert).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def erased_people(spark, sf_dir):
    """Names under a key of each person, read back after every fifth key was deleted."""
    key = F.encode(F.lpad(F.col("c_custkey").cast("string"), 16, "0"), "utf-8")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), G.seal(F.col("c_name"), key).alias("name"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), key.alias("key"))
    return G.unseal(people, G.erase(keys, people.filter("person_id % 5 = 0")), ["name"]).select("person_id", "name")


def contact_fields(spark, sf_dir):
    """Of a contact only its business fields are kept."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("buyer").alias("role"), F.col("c_mktsegment").alias("organisation"), F.concat("c_name", F.lit("@example.com")).alias("business_email"), F.col("c_custkey").cast("string").alias("business_phone"), F.lit("crm").alias("source"), F.lit("private").alias("home_address"))
    return G.contact_fields(rows)


def alert_delay(spark, sf_dir):
    """Seconds from the first sign-up of a user's day to the first view after it: median and longest."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    raised = rows.filter("event_type = 'signup'").groupBy("user_id", "day").agg(F.min("ts").alias("fetched_at"))
    seen = rows.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.max("ts").alias("raised_at"))
    return V.latency(raised.join(seen, ["user_id", "day"]).filter("raised_at >= fetched_at"), "fetched_at", "raised_at")


QUERIES = {f.__name__: f for f in (
    reason_codes_nulls, chain_tamper, cut_ends, missing_evidence, approved_events, auto_events, review_queue, rejections, corrected_events, retracted_events,
    stage_proposals, kanban_as_of, watch_list_as_of, timeline_as_of, role_rights, visible_statuses, erased_people, contact_fields, alert_delay,
)}

_PROPOSED = """
    WITH p AS (
        SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, ts, props, value / 100 AS confidence, CASE WHEN event_id % 2 = 0 THEN 'stated' ELSE 'reported' END AS certainty,
            CASE event_type WHEN 'view' THEN 'EntityIdentified' WHEN 'click' THEN 'DemandDriverObserved' WHEN 'signup' THEN 'EntityMerged' ELSE 'SignalScored' END AS event_type
        FROM events
    )
"""
_AUTO = "(event_type = 'SignalScored' OR (event_type = 'EntityIdentified' AND coalesce(confidence, 0) >= 0.9) OR (event_type = 'DemandDriverObserved' AND certainty = 'stated'))"
_ROLE = "CASE {0} % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END"
SQL = {
    "reason_codes_nulls": """
        SELECT event_id, CASE event_id % 10 WHEN 2 THEN 'unknown_event_type' WHEN 3 THEN 'unknown_stream_type' WHEN 1 THEN 'missing_value' WHEN 4 THEN 'missing_value' WHEN 8 THEN 'missing_value'
            WHEN 5 THEN 'bad_payload' WHEN 7 THEN 'unknown_actor_type' WHEN 6 THEN CASE WHEN event_id % 20 < 10 THEN 'no_evidence' END END AS reason_code FROM events
    """,
    "chain_tamper": _CHAIN + """
        , t AS (
            SELECT event_id, user_id, sequence, CASE WHEN sequence % 17 <> 5 THEN hash END AS hash, CASE WHEN sequence % 17 <> 12 THEN prev_hash END AS prev_hash, content
            FROM c WHERE sequence % 17 <> 9
        ), w AS (
            SELECT *, prev_hash IS NOT NULL AND prev_hash IS NOT DISTINCT FROM lag(hash, 1, '') OVER s AS link_ok,
                coalesce(hash = sha256(prev_hash || '|' || content), false) AS hash_ok, sequence = lag(sequence, 1, 0) OVER s + 1 AS sequence_ok
            FROM t WINDOW s AS (PARTITION BY user_id ORDER BY sequence)
        )
        SELECT event_id, user_id, sequence, link_ok, hash_ok, sequence_ok FROM w WHERE NOT (link_ok AND hash_ok AND sequence_ok)
    """,
    "cut_ends": "SELECT user_id, count(*) AS head, nullif(count(*) - 1, 0) AS last FROM events WHERE user_id % 5 = 0 GROUP BY user_id",
    "missing_evidence": "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'bad' END AS evidence_id FROM events WHERE event_id % 4 <> 1",
    "approved_events": _PROPOSED + """
        SELECT upper(substr(sha256('approved' || chr(31) || id || chr(31) || CAST(event_id % 150 AS VARCHAR)), 1, 26)) AS id, 'entity' AS stream_type, user_id AS stream_id, event_type,
            CASE WHEN event_id % 6 = 0 THEN '{"edited": true}' ELSE props END AS payload, 'e ' || id AS evidence_ids, certainty, 'human' AS actor_type, CAST(event_id % 150 AS VARCHAR) AS actor_id,
            id AS proposal_id, ts AS recorded_at
        FROM p WHERE event_id % 3 = 0 AND CAST(event_id % 150 AS VARCHAR) <> user_id
    """,
    "auto_events": _PROPOSED + f"""
        SELECT upper(substr(sha256('auto' || chr(31) || id), 1, 26)) AS id, 'entity' AS stream_type, user_id AS stream_id, event_type, 'e ' || id AS evidence_ids, certainty, 'agent' AS actor_type,
            user_id AS actor_id, id AS proposal_id, ts AS recorded_at
        FROM p WHERE {_AUTO}
    """,
    "review_queue": _PROPOSED + f"SELECT event_type, count(*) AS n FROM p WHERE NOT {_AUTO} GROUP BY event_type",
    "rejections": "SELECT CAST(event_id AS VARCHAR) AS proposal_id, 'rejected' AS status, 'too vague' AS reason, 'ann' AS actor_id, ts AS recorded_at FROM events WHERE event_id % 10 = 0 AND event_id % 35 <> 0",
    "corrected_events": _PROPOSED + """
        SELECT 'c' || id AS id, 'entity' AS stream_type, user_id AS stream_id, event_type, '{}' AS payload, 'e ' || id AS evidence_ids, 'stated' AS certainty, 'human' AS actor_type, 'ann' AS actor_id,
            id AS supersedes_event_id, ts AS recorded_at FROM p WHERE event_id % 100 = 0
    """,
    "retracted_events": _PROPOSED + """
        SELECT event_type, count(*) AS n FROM (SELECT event_type FROM p WHERE event_id % 40 <> 0 UNION ALL SELECT 'ClaimRetracted' FROM p WHERE event_id % 40 = 0) GROUP BY event_type
    """,
    "stage_proposals": """
        SELECT CAST(event_id AS VARCHAR) AS id, 'DealStageChanged' AS event_type, '{"deal_id":"' || user_id || '","stage":"' || CASE event_type WHEN 'purchase' THEN 'Won' ELSE 'Qualified' END || '","reason":"by phone"}' AS payload,
            'ann' AS created_by, ts AS created_at FROM events WHERE event_type IN ('purchase', 'signup')
    """,
    "kanban_as_of": f"""
        WITH s AS (SELECT arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id),
        k AS (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error', 'other']) AS event_type, unnest([1, 2, 3, 4, 5, 6]) AS place)
        SELECT CAST(place AS BIGINT) AS place, k.event_type, count(s.event_type) AS n FROM k LEFT JOIN s USING (event_type) GROUP BY ALL
    """,
    "watch_list_as_of": f"""
        SELECT u.user_id, e.event_id FROM (SELECT DISTINCT user_id FROM events) u
        LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '{AT}' GROUP BY user_id) e ON u.user_id = e.user_id
    """,
    "timeline_as_of": f"""
        SELECT user_id, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type IN ('purchase', 'signup') AND ts <= TIMESTAMP '{AT}'
    """,
    "role_rights": f"SELECT event_id, {_ROLE.format('event_id')} > 0 AND {_ROLE.format('user_id')} > 0 AND {_ROLE.format('event_id')} >= {_ROLE.format('user_id')} AS may FROM events",
    "visible_statuses": """
        SELECT CASE WHEN event_type = 'signup' THEN 'Unconfirmed' WHEN event_type = 'error' THEN 'Dismissed' WHEN event_id % 3 = 1 THEN 'Reported' WHEN event_id % 3 = 2 THEN 'Speculative' ELSE 'Confirmed' END AS status,
            count(*) AS n FROM events GROUP BY 1
    """,
    "erased_people": "SELECT c_custkey AS person_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer",
    "contact_fields": "SELECT c_name AS name, 'buyer' AS role, c_mktsegment AS organisation, c_name || '@example.com' AS business_email, CAST(c_custkey AS VARCHAR) AS business_phone, 'crm' AS source FROM customer",
    "alert_delay": """
        WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) FILTER (WHERE event_type = 'signup') AS a, max(ts) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY ALL)
        SELECT count(*) AS n, median(datesub('second', a, b)) AS median_s, max(datesub('second', a, b)) AS max_s FROM r WHERE b >= a
    """,
}
