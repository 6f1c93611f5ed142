"""Queries over feeds, page texts, briefs, agents and what they write; pages, orders, nations and events stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import agents as A
from annalist.operators import corrections as K
from annalist.operators import evaluate as V
from annalist.operators import events as E
from annalist.operators import govern as G
from annalist.operators import score as S
from annalist.operators import timing as Tm
from annalist.plans.common import table
from annalist.plans.desk import _at, _log
from annalist.plans.log import AT, ORDER
from annalist.sources import config as C
from annalist.sources import feeds as Fd
from annalist.sources import pages as Pg
from annalist.sources import store as St


def _feeds(spark, sf_dir):
    """A feed for each page: RSS, Atom, RSS without a link, and one that is cut off, in turn."""
    page = F.col("page_id").cast("string")
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    rss = F.concat(F.lit("<rss version='2.0'><channel><title>News</title><item><title> Item "), page, F.lit(" &amp; more</title><link>"), url, F.lit("</link><description>About "), page, F.lit("</description><pubDate>"), F.date_format(day, "dd MMM yyyy"), F.lit(" 10:00:00 +0200</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>News</title><entry><title>Item "), page, F.lit("</title><link href='"), url, F.lit("'/><updated>"), day.cast("string"), F.lit("T08:00:00Z</updated></entry></feed>"))
    bare = F.concat(F.lit("<rss><channel><title>News</title><item><title>Item "), page, F.lit("</title></item></channel></rss>"))
    k = F.col("page_id") % 4
    return table(spark, sf_dir, "pages").select(page.alias("name"), F.when(k == 0, rss).when(k == 1, atom).when(k == 2, bare).otherwise(F.substring(rss, 1, 60)).alias("value"))


def feed_items(spark, sf_dir):
    items = Fd.feed_items(_feeds(spark, sf_dir))
    return items.select("feed", "feed_title", "url", "title", "description", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.col("error").isNotNull().alias("failed"))


def news_sources(spark, sf_dir):
    return Fd.news_sources(Fd.feed_items(_feeds(spark, sf_dir))).select("url", "text", "type", "retention_policy", "read_at_source")


def merged_pages(spark, sf_dir):
    """Order lines as pages of a document; every third has no text layer, only that of a scan."""
    own = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(". ")))
    scanned = F.concat(F.lit("scan "), F.col("l_partkey").cast("string"), F.lit(". "))
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page"), own.alias("text"), scanned.alias("ocr_text"))
    return Pg.merge_pages(pages).select("source_id", "text", F.array_join(F.transform("page_map", lambda x: x.cast("string")), " ").alias("page_map"), "ocr")


def _briefs(spark, sf_dir):
    """A version a nation, one a day; each has a source of its own, an early one if its key is even, and a gap if divisible by 5."""
    entry = lambda kind: F.struct(F.lit(kind).alias("type"), F.concat(F.lit("https://x.example/"), F.col("n_name")).alias("url"), F.lit("0 6 * * *").alias("cron"), F.lit("open").alias("licence_code"))
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("id"),
        F.timestamp_add("DAY", k.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("activated_at"),
        F.array(entry("rss")).alias("sources"),
        F.when(k % 2 == 0, F.array(entry("permit"))).alias("early_signal"),
        F.when(k % 5 == 0, F.array(F.lit("tender"))).alias("gaps"),
    )


def brief_entries(spark, sf_dir):
    """The sources and the gaps of every version."""
    briefs = _briefs(spark, sf_dir)
    gaps = C.known_gaps(briefs).select("brief_version_id", F.col("gap").alias("type"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("boolean").alias("early"))
    return C.brief_sources(briefs).select("brief_version_id", "type", "url", "early").unionByName(gaps)


def uncovered_types(spark, sf_dir):
    """Kinds of sources that no version collects or excuses."""
    briefs = _briefs(spark, sf_dir)
    types = table(spark, sf_dir, "region").select(F.element_at(F.array(*[F.lit(x) for x in ("rss", "permit", "tender", "hiring", "import")]), (F.col("r_regionkey") + 1).cast("int")).alias("type"))
    return C.uncovered(types, C.brief_sources(briefs), C.known_gaps(briefs))


def accepted_source(spark, sf_dir):
    """The version that is active then, and the new one that has one source more."""
    briefs = _briefs(spark, sf_dir)
    new = C.accept_source(briefs, C.active_brief(briefs, _at()).first()["id"], "next", "2024-03-01", ("pdf", "https://y.example", "0 0 * * 1", "open"))
    return C.brief_sources(new).select("brief_version_id", "type", "url", "early")


def stamped_events(spark, sf_dir):
    """Events under the version that is active then."""
    rows = C.stamp_brief(table(spark, sf_dir, "events").select("event_id", "event_type"), C.active_brief(_briefs(spark, sf_dir), _at()))
    return rows.groupBy("event_type", "brief_version_id").agg(F.count(F.lit(1)).alias("n"))


def gold_coverage(spark, sf_dir):
    code = F.when(F.col("event_type") == "purchase", "procurement").when(F.col("event_type") == "signup", "demand_driver").otherwise("none")
    return Pg.gold_coverage(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), code.alias("code")))


def manual_sources(spark, sf_dir):
    return St.register_manual(table(spark, sf_dir, "pages").select("page_id", "url"))


def raised_alerts(spark, sf_dir):
    """AlertRaised events of errors, which are of tier 0 here."""
    rows = _log(spark, sf_dir).withColumn("tier", F.when(F.col("id").cast("long") % 11 == 0, 0).otherwise(1))
    return G.alert_events(rows).select("id", "stream_type", "stream_id", "event_type", "payload", F.array_join("evidence_ids", " ").alias("evidence_ids"), "actor_type", "actor_id", "recorded_at")


def merge_reviews(spark, sf_dir):
    """Merges are for review, all of them."""
    return A.route_merges(_log(spark, sf_dir)).select("id", "event_type", "decision")


def quarantine_rows(spark, sf_dir):
    """What a payload rule refused, as rows of the quarantine."""
    rows = table(spark, sf_dir, "events").withColumn("reason_code", F.when(F.col("value") < 10, "bad_payload"))
    return A.quarantined(rows, "event_id", "extract", F.col("props"), F.col("ts"))


def model_calls(spark, sf_dir):
    """The call log of an agent that says how many tokens it read."""
    agent = lambda rows: rows.select("o_orderkey", F.col("o_orderstatus").alias("said"), (F.col("o_orderkey") % 7).alias("tokens"))
    out, calls = A.log_calls(agent, "status", "rules", "v1", ["o_orderkey"], ["said"])(table(spark, sf_dir, "orders"))
    return calls.select("id", "model_id", "prompt_version", "input_hash", "output", "tokens", "latency_s")


def rebuilt_states(spark, sf_dir):
    """Two projections from the log alone."""
    log = _log(spark, sf_dir).select("*", F.lit(None).cast("string").alias("supersedes_event_id"), F.col("id").cast("long").alias("sequence"))
    made = K.rebuild(log, {"streams": (["stream_id"], ["id"]), "kinds": (["event_type"], ["id"])})
    return made["streams"].select(F.lit("streams").alias("projection"), F.col("stream_id").alias("key"), "id").unionByName(made["kinds"].select(F.lit("kinds").alias("projection"), F.col("event_type").alias("key"), "id"))


def state_at(spark, sf_dir):
    """The last event of each user that was known then."""
    return E.state_at(table(spark, sf_dir, "events"), _at(), ["user_id"], list(ORDER), ["event_id", "event_type"], time="ts").select("user_id", "event_id", "event_type")


def scorer(spark, sf_dir):
    """Score and tier of customers, with one judged feature for every third."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    judged = rows.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 10).alias("judged"))
    found = S.scorer(rows, "c_custkey", {"c_acctbal": 0.001, "judged": 3.0}, [("c_acctbal > 5000 AND judged >= 5", 0), ("c_acctbal > 5000", 1)], judged)
    return found.select("c_custkey", F.round("score", 6).alias("score"), F.round(F.col("parts")["judged"], 6).alias("judged_part"), "tier")


def evaluation(spark, sf_dir):
    """Measures of a run that guesses the status of an order by its key."""
    guess = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return V.evaluate(table(spark, sf_dir, "orders").withColumn("guess", guess), "guess", "o_orderstatus").select("metric", F.round("value", 9).alias("value"))


def backoff_spread(spark, sf_dir):
    """Jitter stays within a minute and is the same each time."""
    rows = table(spark, sf_dir, "pages").select("url", Tm.jitter_seconds(F.col("url")).alias("s"))
    return rows.groupBy("url").agg(F.count_distinct("s").alias("values"), F.min(F.col("s").between(0, 59)).alias("within"))


QUERIES = {f.__name__: f for f in (
    feed_items, news_sources, merged_pages, brief_entries, uncovered_types, accepted_source, stamped_events, gold_coverage, manual_sources, raised_alerts,
    merge_reviews, quarantine_rows, model_calls, rebuilt_states, state_at, scorer, evaluation, backoff_spread,
)}

_DAY = "(DATE '2024-01-01' + CAST(page_id % 300 AS INT))"
_ACTIVE = f"SELECT n_name FROM nation WHERE TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INT)) <= TIMESTAMP '{AT}' ORDER BY n_nationkey DESC, n_name DESC LIMIT 1"
_KIND = "CASE event_type WHEN 'view' THEN 'EntityIdentified' WHEN 'click' THEN 'DemandDriverObserved' WHEN 'signup' THEN 'EntityMerged' ELSE 'SignalScored' END"
SQL = {
    "feed_items": f"""
        SELECT CAST(page_id AS VARCHAR) AS feed, CASE WHEN page_id % 4 <> 3 THEN 'News' END AS feed_title, CASE WHEN page_id % 4 <= 1 THEN url END AS url,
            CASE page_id % 4 WHEN 0 THEN 'Item ' || page_id || ' & more' WHEN 3 THEN NULL ELSE 'Item ' || page_id END AS title,
            CASE WHEN page_id % 4 = 0 THEN 'About ' || page_id END AS description, CASE WHEN page_id % 4 <= 1 THEN CAST({_DAY} AS TIMESTAMP) + INTERVAL 8 HOUR END AS published_at,
            page_id % 4 = 3 AS failed FROM pages
    """,
    "news_sources": """
        SELECT url, CASE WHEN page_id % 4 = 0 THEN 'Item ' || page_id || ' & more' || chr(10) || 'About ' || page_id ELSE 'Item ' || page_id END AS text, 'rss' AS type, 'link_only' AS retention_policy,
            false AS read_at_source FROM pages WHERE page_id % 4 <= 1
    """,
    "merged_pages": """
        WITH p AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN l_linenumber % 3 <> 0 THEN 'line ' || l_linenumber || '. ' ELSE 'scan ' || l_partkey || '. ' END AS t FROM lineitem),
        s AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY l_orderkey ORDER BY k, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start" FROM p)
        SELECT l_orderkey AS source_id, string_agg(t, '' ORDER BY k, t) AS text, string_agg(CAST("start" AS VARCHAR), ' ' ORDER BY "start") AS page_map, bool_or(k % 3 = 0) AS ocr FROM s GROUP BY l_orderkey
    """,
    "brief_entries": """
        SELECT n_name AS brief_version_id, 'rss' AS type, 'https://x.example/' || n_name AS url, false AS early FROM nation
        UNION ALL SELECT n_name, 'permit', 'https://x.example/' || n_name, true FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT n_name, 'tender', NULL, NULL FROM nation WHERE n_nationkey % 5 = 0
    """,
    "uncovered_types": "SELECT CASE r_regionkey WHEN 3 THEN 'hiring' ELSE 'import' END AS type FROM region WHERE r_regionkey IN (3, 4)",
    "accepted_source": f"""
        WITH a AS ({_ACTIVE})
        SELECT 'next' AS brief_version_id, 'rss' AS type, 'https://x.example/' || n_name AS url, false AS early FROM a UNION ALL SELECT 'next', 'pdf', 'https://y.example', false
        UNION ALL SELECT 'next', 'permit', 'https://x.example/' || n_name, true FROM a JOIN nation USING (n_name) WHERE n_nationkey % 2 = 0
    """,
    "stamped_events": f"SELECT event_type, ({_ACTIVE}) AS brief_version_id, count(*) AS n FROM events GROUP BY event_type",
    "gold_coverage": """
        SELECT count(DISTINCT user_id) AS documents, count(*) FILTER (WHERE event_type = 'signup') AS drivers, count(*) FILTER (WHERE event_type = 'purchase') AS procurements FROM events
    """,
    "manual_sources": "SELECT page_id, url, 'manual' AS type FROM pages",
    "raised_alerts": """
        SELECT upper(substr(sha256('alert' || chr(31) || event_id), 1, 26)) AS id, 'entity' AS stream_type, CAST(user_id AS VARCHAR) AS stream_id, 'AlertRaised' AS event_type,
            '{"signal_id":"' || event_id || '","status":"unconfirmed"}' AS payload, 'e ' || event_id AS evidence_ids, 'system' AS actor_type, 'alerts' AS actor_id, ts AS recorded_at
        FROM events WHERE event_id % 11 = 0
    """,
    "merge_reviews": "SELECT CAST(event_id AS VARCHAR) AS id, 'EntityMerged' AS event_type, 'review' AS decision FROM events WHERE event_type = 'signup'",
    "quarantine_rows": "SELECT CAST(event_id AS VARCHAR) AS id, 'extract' AS step, props AS output, 'bad_payload' AS reason_code, ts AS created_at FROM events WHERE value < 10",
    "model_calls": """
        SELECT upper(substr(sha256('status' || chr(31) || o_orderkey), 1, 26)) AS id, 'rules' AS model_id, 'v1' AS prompt_version, sha256('{"o_orderkey":' || o_orderkey || '}') AS input_hash,
            '{"said":"' || o_orderstatus || '"}' AS output, o_orderkey % 7 AS tokens, CAST(NULL AS DOUBLE) AS latency_s FROM orders
    """,
    "rebuilt_states": f"""
        SELECT 'streams' AS projection, CAST(user_id AS VARCHAR) AS key, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS id FROM events GROUP BY user_id
        UNION ALL SELECT 'kinds', {_KIND}, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) FROM events GROUP BY {_KIND}
    """,
    "state_at": f"SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id",
    "scorer": """
        WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 END AS judged FROM customer)
        SELECT c_custkey, round(c_acctbal * 0.001 + coalesce(judged, 0) * 3.0, 6) AS score, CAST(coalesce(judged, 0) * 3 AS DOUBLE) AS judged_part,
            CASE WHEN c_acctbal > 5000 AND judged >= 5 THEN 0 WHEN c_acctbal > 5000 THEN 1 ELSE 2 END AS tier FROM c
    """,
    "evaluation": """
        WITH o AS (SELECT o_orderstatus AS a, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS p FROM orders),
        n AS (SELECT c, count(*) FILTER (WHERE p = c AND a = c) AS hits, count(*) FILTER (WHERE p = c) AS np, count(*) FILTER (WHERE a = c) AS na FROM o, (SELECT a AS c FROM o UNION SELECT p FROM o) GROUP BY c),
        m AS (SELECT c, CASE WHEN np > 0 THEN hits / np ELSE 0 END AS pr, CASE WHEN na > 0 THEN hits / na ELSE 0 END AS re FROM n WHERE np + na > 0),
        f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
        SELECT 'precision ' || c AS metric, round(pr, 9) AS value FROM f UNION ALL SELECT 'recall ' || c, round(re, 9) FROM f UNION ALL SELECT 'f1 ' || c, round(f1, 9) FROM f
        UNION ALL SELECT 'macro f1', round(avg(f1), 9) FROM f
    """,
    "backoff_spread": 'SELECT url, 1 AS "values", true AS within FROM pages GROUP BY url',
}
