"""Queries over resolution, scores, governance and panels; orders, events, labels and embeddings stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators import evaluate as V
from annalist.operators import govern as G
from annalist.operators import panels as P
from annalist.operators import resolve as R
from annalist.operators import score as S
from annalist.plans.common import table

TIERS = [("o_orderpriority = '1-URGENT' AND o_totalprice > 200000", 0), ("o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice > 300000", 1)]
ORDER_STATES = ("F", "O", "P", "X")
MOVES = {"signup": "unconfirmed", "purchase": "confirmed", "error": "dismissed"}


def classification_metrics(spark, sf_dir):
    """A document of 200 characters or more is called good; each class with its metrics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 200).cast("int").alias("predicted"))
    pairs = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return V.per_class(pairs, "predicted", "quality").select("class", "hits", "n_predicted", "n_actual", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def macro_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 200).cast("int").alias("predicted"))
    pairs = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return V.macro_f1(V.per_class(pairs, "predicted", "quality")).select(F.round("macro_f1", 9).alias("macro_f1"), "classes")


def fp_rate(spark, sf_dir):
    alerts = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return V.rate_by(alerts, ["source"], F.col("quality") == 0, "fp_rate")


def alert_latency(spark, sf_dir):
    """Seconds from each event to the next of its user, by kind: mean and longest."""
    nxt = F.lead("ts").over(R.W.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = table(spark, sf_dir, "events").withColumn("gap_s", F.timestamp_diff("SECOND", F.col("ts"), nxt))
    return gaps.groupBy("event_type").agg(F.round(F.avg("gap_s"), 6).alias("mean_s"), F.max("gap_s").alias("max_s"), F.count("gap_s").alias("n"))


def _alerts(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))


def alert_timeline(spark, sf_dir):
    return G.alert_timeline(_alerts(spark, sf_dir), ["user_id", "day"], "event_type", "ts", "signup", "click", "view", ["purchase", "error"])


def alert_status(spark, sf_dir):
    return G.status(_alerts(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"], "event_type", MOVES)


def proposal_status(spark, sf_dir):
    return G.status(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", {"signup": "created", "purchase": "approved", "error": "rejected", "click": "edited"})


def source_health(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    health = V.source_health(rows, "user_id", F.col("event_type") != "error", "ts", F.lit(1))
    return health.select("user_id", "last_success", F.round("error_rate", 9).alias("error_rate"), "documents", "runs")


def self_approval(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("created_by"), (F.col("event_id") % 150).alias("actor_id"))
    return G.self_approvals(rows).select("event_id", "created_by")


def approval_routes(spark, sf_dir):
    """Events as proposals, with their value as confidence in percent: how many are routed where."""
    kind = F.when(F.col("event_type") == "view", "EntityIdentified").when(F.col("event_type") == "click", "DemandDriverObserved").when(F.col("event_type") == "signup", "EntityMerged").otherwise("SignalScored")
    sure = F.when(F.col("event_id") % 2 == 0, "stated").otherwise("reported")
    rows = table(spark, sf_dir, "events").withColumn("kind", kind).withColumn("decision", G.approval(kind, sure, F.col("value") / 100))
    return rows.groupBy("kind", "decision").agg(F.count(F.lit(1)).alias("n"))


def vector_topk(spark, sf_dir):
    """Queries: every vector whose id is divisible by 100, against all."""
    rows = table(spark, sf_dir, "embeddings")
    return R.vector_topk(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5).select("query", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def trigram_candidates(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return R.trigram_links(names, "p_partkey", "p_name", 0.6)


def name_match(spark, sf_dir):
    """Customers and suppliers with the same digits in their name, by nation."""
    digits = lambda c: F.regexp_replace(F.regexp_extract(c, "([0-9]+)", 1), "^0+", "")
    left = table(spark, sf_dir, "customer").select("c_custkey", digits("c_name").alias("name"), F.col("c_nationkey").alias("country"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", digits("s_name").alias("name"), F.col("s_nationkey").alias("country"))
    return R.match_name(left, right).select("c_custkey", "s_suppkey", "name_key")


def feed(spark, sf_dir):
    rows = P.feed(table(spark, sf_dir, "orders"), o_orderpriority=["1-URGENT", "2-HIGH"], o_orderstatus=["O"])
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


def collect_all(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return P.collect_all(customers, suppliers)


def _tiered(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("tier", S.tier(TIERS))


def tier_counts(spark, sf_dir):
    return _tiered(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def priority_list(spark, sf_dir):
    """Customers ranked within their nation: urgent open orders first, then by value and balance."""
    open_value = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"), F.count(F.lit(1)).alias("n_open"))
    rows = table(spark, sf_dir, "customer").join(open_value, "c_custkey", "left").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    ranked = S.priority(rows, ["n_name"], F.coalesce("urgent", F.lit(0)), [F.coalesce("n_open", F.lit(0)).desc(), F.col("c_acctbal").desc(), F.col("c_custkey")])
    return ranked.select("n_name", "c_custkey", "rank")


def ticker(spark, sf_dir):
    rows = _tiered(spark, sf_dir).filter("tier < 2")
    return P.ticker(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20).select("o_orderkey", "tier")


def kanban(spark, sf_dir):
    return V.count_by_scale(table(spark, sf_dir, "orders"), "o_orderstatus", ORDER_STATES)


def project_pipeline(spark, sf_dir):
    """Users by the stage of their last event, engagement window flagged."""
    from annalist.operators import events as E
    from annalist.operators.timing import in_window
    from annalist.plans.common import staged

    now = E.project_state(staged(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["stage"])
    return now.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).withColumn("in_window", in_window(F.col("stage")))


def _evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("evidence_id"), "l_partkey", (F.col("l_returnflag") != "R").alias("verified"))


def _named(spark, sf_dir):
    """Orders that name lines 1 to 3 as evidence, whether the order has them or not."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat_ws(":", F.col("o_orderkey").cast("string"), k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", ids.alias("ids"))


def event_evidence(spark, sf_dir):
    return P.with_evidence(_named(spark, sf_dir), _evidence(spark, sf_dir), "ids", "evidence_id").select("o_orderkey", "evidence_id", "l_partkey")


def unverified_facts(spark, sf_dir):
    from annalist.operators.documents import unverified_facts as missing

    return missing(_named(spark, sf_dir), _evidence(spark, sf_dir), "o_orderkey", "ids", "evidence_id").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_missing"))


def timeline(spark, sf_dir):
    """Evidence of each order in order of time, with the part as its source."""
    rows = P.with_evidence(_named(spark, sf_dir), _evidence(spark, sf_dir), "ids", "evidence_id").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    place = F.row_number().over(R.W.partitionBy("p_name").orderBy("o_orderdate", "evidence_id"))
    return rows.select("o_orderkey", "evidence_id", "p_name", place.cast("long").alias("place"))


def no_contact(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return P.no_contact(table(spark, sf_dir, "customer"), urgent, "c_custkey").select("c_custkey", "c_name")


def project_buyers(spark, sf_dir):
    """Each nation with one supplier for each range of balance."""
    role = F.when(F.col("s_acctbal") < 0, "low").when(F.col("s_acctbal") < 5000, "middle").otherwise("high")
    roles = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), role.alias("role"), "s_name")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.buyers(nations, roles, "n_nationkey", "role", "s_name", ["low", "middle", "high"]).select("n_nationkey", "n_name", "r_name", "low", "middle", "high")


def watch_list(spark, sf_dir):
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus")
    return P.watch_list(table(spark, sf_dir, "customer"), reports, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_orderstatus")


def coverage(spark, sf_dir):
    """Two systems see orders: one those of high value, the other those of high priority, a day later for even keys."""
    orders = table(spark, sf_dir, "orders")
    a = orders.filter("o_totalprice > 100000").select("o_orderkey", "o_orderdate")
    b = orders.filter("o_orderpriority <= '3'").select("o_orderkey", (F.col("o_orderdate") + F.expr("CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END")).alias("o_orderdate"))
    return V.compare_systems(a, b, "o_orderkey", "o_orderdate").groupBy("found_in", "first").agg(F.count(F.lit(1)).alias("n"))


def brief_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.version_diff(orders.filter("o_orderpriority <= '3'"), orders.filter("o_orderstatus <> 'F'"), ["o_custkey", "o_orderpriority", "o_orderstatus"])


def demand_estimate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    rows = S.estimate(table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left"), "quantity * (1 - discount) / 10", ["quantity", "discount"])
    rows = rows.withColumn("x", S.score({"quantity": 0.5, "o_totalprice": 0.001}))
    return rows.select("o_orderkey", F.round("estimate", 6).alias("estimate"), F.round("x.score", 6).alias("score"))


def language_mix(spark, sf_dir):
    """How many documents of each language use reported or speculative wording."""
    sure = X.certainty(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang", sure.alias("certainty")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    classification_metrics, macro_f1, fp_rate, alert_latency, alert_timeline, alert_status, proposal_status, source_health, self_approval, approval_routes, vector_topk,
    trigram_candidates, name_match, feed, collect_all, tier_counts, priority_list, ticker, kanban, project_pipeline, event_evidence, unverified_facts, timeline,
    no_contact, project_buyers, watch_list, coverage, brief_diff, demand_estimate, language_mix,
)}

_METRICS = """
    WITH x AS (SELECT CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END AS p, quality AS a FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT p AS class FROM x UNION SELECT a FROM x),
    m AS (
        SELECT class, (SELECT count(*) FROM x WHERE p = class AND a = class) AS hits, (SELECT count(*) FROM x WHERE p = class) AS n_predicted, (SELECT count(*) FROM x WHERE a = class) AS n_actual FROM c
    ), r AS (SELECT *, CASE WHEN n_predicted > 0 THEN hits / n_predicted ELSE 0 END AS pr, CASE WHEN n_actual > 0 THEN hits / n_actual ELSE 0 END AS re FROM m),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM r)
"""
_TIER = "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 200000 THEN 0 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice > 300000 THEN 1 ELSE 2 END"
_STATUS = "SELECT {key}, arg_max(CASE event_type {moves} END, (ts, event_id)) AS status, count(*) AS n_events FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) WHERE event_type IN ({kinds}) GROUP BY ALL"
_NAMED = """
    WITH e AS (SELECT l_orderkey || ':' || l_linenumber AS evidence_id, l_partkey, l_returnflag <> 'R' AS verified FROM lineitem),
    n AS (SELECT o_orderkey, o_orderdate, o_orderkey || ':' || k AS evidence_id FROM orders, (SELECT unnest([1, 2, 3]) AS k))
"""
SQL = {
    "classification_metrics": _METRICS + "SELECT class, hits, n_predicted, n_actual, round(pr, 9) AS precision, round(re, 9) AS recall, round(f, 9) AS f1 FROM f",
    "macro_f1": _METRICS + "SELECT round(avg(f), 9) AS macro_f1, count(*) AS classes FROM f",
    "fp_rate": "SELECT source, avg(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS fp_rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "alert_latency": """
        SELECT event_type, round(avg(g), 6) AS mean_s, max(g) AS max_s, count(g) AS n
        FROM (SELECT event_type, datesub('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events) GROUP BY event_type
    """,
    "alert_timeline": """
        WITH a AS (
            SELECT user_id, CAST(ts AS DATE) AS day, min(ts) FILTER (WHERE event_type = 'signup') AS raised_at, min(ts) FILTER (WHERE event_type = 'click') AS delivered_at,
                min(ts) FILTER (WHERE event_type = 'view') AS acknowledged_at, arg_min(event_type, (ts, event_type)) FILTER (WHERE event_type IN ('purchase', 'error')) AS outcome
            FROM events GROUP BY ALL
        )
        SELECT *, CASE WHEN acknowledged_at >= raised_at THEN datesub('second', raised_at, acknowledged_at) END AS ack_s FROM a WHERE raised_at IS NOT NULL
    """,
    "alert_status": _STATUS.format(key="user_id, day", moves="WHEN 'signup' THEN 'unconfirmed' WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'dismissed'", kinds="'signup', 'purchase', 'error'"),
    "proposal_status": _STATUS.format(key="user_id", moves="WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'edited'", kinds="'signup', 'purchase', 'error', 'click'"),
    "source_health": """
        SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_success, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 9) AS error_rate,
            count(*) AS documents, count(*) AS runs FROM events GROUP BY user_id
    """,
    "self_approval": "SELECT event_id, user_id AS created_by FROM events WHERE event_id % 150 = user_id",
    "approval_routes": """
        WITH k AS (SELECT CASE event_type WHEN 'view' THEN 'EntityIdentified' WHEN 'click' THEN 'DemandDriverObserved' WHEN 'signup' THEN 'EntityMerged' ELSE 'SignalScored' END AS kind, event_id, value FROM events)
        SELECT kind, CASE WHEN kind = 'SignalScored' OR (kind = 'EntityIdentified' AND coalesce(value / 100, 0) >= 0.9) OR (kind = 'DemandDriverObserved' AND event_id % 2 = 0) THEN 'auto' ELSE 'review' END AS decision, count(*) AS n
        FROM k GROUP BY ALL
    """,
    "vector_topk": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s)
        SELECT query, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5
    """,
    "trigram_candidates": """
        WITH n AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name),
        t AS (SELECT p_partkey, list_sort(list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3)))) AS g FROM n),
        c AS (SELECT g, min(p_partkey) AS class_id, len(g) AS size FROM t GROUP BY g),
        u AS (SELECT class_id, size, unnest(g) AS x FROM c),
        o AS (SELECT a.class_id, b.class_id AS other, count(*) AS k, any_value(a.size) AS sa, any_value(b.size) AS sb FROM u a JOIN u b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY ALL),
        l AS (SELECT class_id, count(*) AS n_links FROM o WHERE k / (sa + sb - k) >= 0.6 GROUP BY class_id)
        SELECT t.p_partkey, c.class_id, coalesce(l.n_links, 0) AS n_links FROM t JOIN c ON t.g = c.g LEFT JOIN l ON l.class_id = c.class_id
    """,
    "name_match": """
        WITH c AS (SELECT c_custkey, c_nationkey AS k, regexp_replace(regexp_extract(c_name, '([0-9]+)', 1), '^0+', '') AS name_key FROM customer),
        s AS (SELECT s_suppkey, s_nationkey AS k, regexp_replace(regexp_extract(s_name, '([0-9]+)', 1), '^0+', '') AS name_key FROM supplier)
        SELECT c_custkey, s_suppkey, name_key FROM c JOIN s USING (name_key, k)
    """,
    "feed": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'",
    "collect_all": "SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier",
    "tier_counts": f"SELECT {_TIER} AS tier, count(*) AS n FROM orders GROUP BY 1",
    "priority_list": """
        WITH o AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
        SELECT n_name, c_custkey, row_number() OVER (PARTITION BY n_name ORDER BY coalesce(urgent, 0) DESC, coalesce(n_open, 0) DESC, c_acctbal DESC, c_custkey) AS rank
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey
    """,
    "ticker": f"SELECT o_orderkey, tier FROM (SELECT *, {_TIER} AS tier FROM orders) WHERE tier < 2 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "kanban": """
        SELECT place, s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES (1::BIGINT, 'F'), (2, 'O'), (3, 'P'), (4, 'X')) t(place, s) LEFT JOIN orders ON o_orderstatus = s GROUP BY ALL
    """,
    "project_pipeline": """
        WITH l AS (SELECT arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id),
        s AS (SELECT CASE t WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 8 WHEN 'error' THEN 10 END AS stage FROM l)
        SELECT stage, count(*) AS n, stage BETWEEN 4 AND 8 AS in_window FROM s GROUP BY stage
    """,
    "event_evidence": _NAMED + "SELECT o_orderkey, evidence_id, l_partkey FROM n JOIN e USING (evidence_id)",
    "unverified_facts": _NAMED + "SELECT o_orderkey, count(*) AS n_missing FROM n WHERE evidence_id NOT IN (SELECT evidence_id FROM e WHERE verified) GROUP BY o_orderkey",
    "timeline": _NAMED + "SELECT o_orderkey, evidence_id, p_name, row_number() OVER (PARTITION BY p_name ORDER BY o_orderdate, evidence_id) AS place FROM n JOIN e USING (evidence_id) JOIN part ON p_partkey = l_partkey",
    "no_contact": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "project_buyers": """
        SELECT n_nationkey, n_name, r_name, min(s_name) FILTER (WHERE s_acctbal < 0) AS low, min(s_name) FILTER (WHERE s_acctbal >= 0 AND s_acctbal < 5000) AS middle,
            min(s_name) FILTER (WHERE s_acctbal >= 5000) AS high
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
    """,
    "watch_list": """
        SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (
            SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
        ) ON o_custkey = c_custkey
    """,
    "coverage": """
        WITH a AS (SELECT o_orderkey, o_orderdate AS x FROM orders WHERE o_totalprice > 100000),
        b AS (SELECT o_orderkey, o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS y FROM orders WHERE o_orderpriority <= '3')
        SELECT CASE WHEN x IS NULL THEN 'b' WHEN y IS NULL THEN 'a' ELSE 'both' END AS found_in, CASE WHEN x < y THEN 'a' WHEN y < x THEN 'b' WHEN x = y THEN 'tie' END AS first, count(*) AS n
        FROM a FULL JOIN b USING (o_orderkey) GROUP BY ALL
    """,
    "brief_diff": """
        WITH a AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority <= '3'), b AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'F')
        SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    """,
    "demand_estimate": """
        WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, round(q * (1 - d) / 10, 6) AS estimate, round(coalesce(q, 0) * 0.5 + o_totalprice * 0.001, 6) AS score FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
    """,
    "language_mix": r"""
        SELECT lang, CASE WHEN regexp_matches(lower(text), '\b(in talks|may|might|could|considering|rumou?r|rumou?red|speculation|possible|possibly)\b') THEN 'speculative'
            WHEN regexp_matches(lower(text), '\b(reportedly|sources say|sources said|according to|people familiar|is said to|reports say)\b') THEN 'reported' ELSE 'stated' END AS certainty, count(*) AS n
        FROM documents GROUP BY ALL
    """,
}
