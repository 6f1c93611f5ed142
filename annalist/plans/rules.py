"""Queries over value parsers, rules of sources, claims and resolution; orders, documents and customers stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators import agents as A
from annalist.operators import corrections as K
from annalist.operators import documents as D
from annalist.operators import evaluate as V
from annalist.operators import govern as G
from annalist.operators import panels as P
from annalist.operators import resolve as R
from annalist.operators import score as S
from annalist.operators import timing as Tm
from annalist.plans.common import table
from annalist.sources import config as C
from annalist.sources import store as St

TAXONOMY = {"article": ["the", "la", "der"], "joining": ["and", "et", "und"]}
PHASES = {"exploration": 1, "under construction": 6, "commissioned": 9}


def _cents(column: str = "o_totalprice"):
    return F.round(F.col(column) * 100).cast("long")


def parsed_values(spark, sf_dir):
    """Amounts, percentages and dates written out of the orders, and read back from the wording."""
    rows = table(spark, sf_dir, "orders").withColumn("cents", _cents())
    money = X.parse_money(F.concat(F.lit("about €"), F.format_number("cents", 0), F.lit(" million paid")))
    share = X.parse_percent(F.concat(F.lit("grew by "), (F.col("o_custkey") % 90).cast("string"), F.lit(".5 per cent")))
    day = X.parse_date(F.date_format(F.col("o_orderdate").cast("date"), "d MMMM yyyy"))
    number = X.parse_number(F.concat(F.lit("some "), F.col("o_orderkey").cast("string"), F.lit("k units")))
    return rows.select("o_orderkey", money["amount"].cast("double").alias("amount"), money["currency"].alias("currency"), share.cast("double").alias("share"), day.alias("day"), number.cast("double").alias("units"))


def value_in_quote(spark, sf_dir):
    """The amount of even orders stands in the quote in another form, that of odd ones does not."""
    rows = table(spark, sf_dir, "orders").withColumn("cents", _cents())
    said = F.when(F.col("o_orderkey") % 2 == 0, F.col("cents") * 1000).otherwise(F.col("cents") * 1000 + 7)
    quote = F.concat(F.lit("sold for $"), F.format_number(said, 0), F.lit(" in 9 parts"))
    return rows.select("o_orderkey", X.value_in_quote(F.concat(F.col("cents").cast("string"), F.lit("k")), quote).alias("found"))


def normalised_texts(spark, sf_dir):
    text = F.regexp_replace(F.concat("text", F.lit("é \r\nend\r")), "a", "ä")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalise(text), 256).alias("text_sha256"))


def name_keys(spark, sf_dir):
    said = F.concat(F.lit("  "), F.col("c_name"), F.lit(" Mining  Co., Ltd "))
    return table(spark, sf_dir, "customer").select("c_custkey", X.name_key(said).alias("name_key"))


def robots_allowed(spark, sf_dir):
    """Every host bars one folder, but for the paths in it that begin with 1."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url")).alias("host"), F.regexp_extract("url", "://[^/]+([^?#]*)", 1).alias("path"))
    rules = pages.select("host").distinct().select("host", F.explode(F.array(F.struct(F.lit("/en/").alias("prefix"), F.lit(False).alias("allow")), F.struct(F.lit("/en/1").alias("prefix"), F.lit(True).alias("allow")))).alias("r")).select("host", "r.*")
    return D.allowed(pages, rules).select("page_id", "allowed")


def external_matches(spark, sf_dir):
    """Customers and suppliers that have a registration number in common."""
    ids = lambda nation, key: F.create_map(F.lit("registry"), F.concat_ws("-", F.col(nation).cast("string"), (F.col(key) % 10).cast("string")), F.lit("none"), F.lit(None).cast("string"))
    mentions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention_id"), ids("c_nationkey", "c_custkey").alias("external_ids"))
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), ids("s_nationkey", "s_suppkey").alias("external_ids"))
    return R.match_external(mentions, entities)


def mention_candidates(spark, sf_dir):
    """Parts whose key is divisible by 100, with a changed name, against the names of all: the three best by trigrams."""
    parts = table(spark, sf_dir, "part")
    mentions = parts.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("mention_id"), F.concat(F.lit("x"), F.col("p_name")).alias("name"))
    entities = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    found = R.candidates(mentions, entities, k=3, least=0.5)
    return found.select("mention_id", "entity_id", F.round("confidence", 9).alias("confidence"), "rank")


def resolve_decisions(spark, sf_dir):
    """External ids first, then names: customers divisible by 3 have an id, even ones a name, those divisible by 4 two names."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention_id"), F.col("c_nationkey").alias("entity_id"))
    by_id = rows.filter("mention_id % 3 = 0").withColumn("confidence", F.lit(1.0))
    by_name = rows.filter("mention_id % 2 = 0").withColumn("confidence", F.when(F.col("mention_id") % 10 == 0, 0.7).otherwise(0.95))
    second = by_name.filter("mention_id % 4 = 0").withColumn("entity_id", F.col("entity_id") - 100)
    return R.decide(rows, by_id, by_name.unionByName(second)).select("mention_id", "entity_id", "confidence", "decision")


def _merges(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 4 != 0).select(k.alias("entity_id"), F.floor(k / 3).alias("merged_into"), k.alias("at"))


def merged_ids(spark, sf_dir):
    """Customers merged into that of a third of their key, but for those divisible by 4."""
    return R.canonical_ids(_merges(spark, sf_dir))


def split_ids(spark, sf_dir):
    """The merges of customers divisible by 5 were undone by a later split, those of customers divisible by 7 before they were made."""
    merges = _merges(spark, sf_dir)
    later = merges.filter("entity_id % 5 = 0").withColumn("at", F.col("at") + 1)
    splits = later.unionByName(merges.filter("entity_id % 7 = 0").withColumn("at", F.col("at") - 1)).select("entity_id", F.col("merged_into").alias("split_from"), "at")
    return R.canonical_ids(R.active_merges(merges, splits))


def _claims(spark, sf_dir):
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was placed for $"), _cents().cast("string"), F.lit("k. It may close."))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), text.alias("text"))
    return docs, A.extract(docs, "source_id", "text", {"order_value": r"\bplaced for\b"})


def extracted_claims(spark, sf_dir):
    rows = _claims(spark, sf_dir)[1].withColumn("value", F.col("value").cast("double"))
    return rows.select("source_id", "predicate", "value", "currency", "certainty", "char_start", "char_end", "quote", "quote_hash")


def guarded_claims(spark, sf_dir):
    """Claims of which some have an unknown predicate, a moved span, or a value that is not in their quote."""
    docs, claims = _claims(spark, sf_dir)
    k = F.col("source_id")
    claims = claims.withColumn("predicate", F.when(k % 7 == 0, "rumour").otherwise(F.col("predicate")))
    claims = claims.withColumn("char_start", F.when(k % 3 == 0, F.col("char_start") + 1).otherwise(F.col("char_start")))
    claims = claims.withColumn("value", F.when(k % 5 == 0, "7").otherwise(F.col("value")))
    return A.guard(claims, docs, ["order_value"]).select("source_id", "reason_code")


def quarantined_claims(spark, sf_dir):
    """An agent whose output has a wrong type for orders divisible by 4, and on being asked again still for those divisible by 8."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    asked = [0]

    def agent(given):
        asked[0] += 1
        bad = F.col("o_orderkey") % (4 if asked[0] == 1 else 8) == 0
        return given.select("o_orderkey", F.concat(F.lit('{"stage": '), F.when(bad, '"four"').otherwise("4"), F.lit("}")).alias("output"))

    return A.with_retry(agent, rows, "o_orderkey", "output", {"stage": "int"}).select("o_orderkey", "output", "reason_code")


def payload_checks(spark, sf_dir):
    k = F.col("event_id") % 4
    payload = F.when(k == 0, '{"k": "5"}').when(k == 1, '{"n": 1}').when(k == 2, "not json").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", A.valid_payload(payload, {"k": "int"}).alias("ok"))


def classified(spark, sf_dir):
    return A.classify(table(spark, sf_dir, "documents"), "doc_id", "text", TAXONOMY).select("doc_id", F.array_join("codes", " ").alias("codes"), "in_scope")


def lifecycle_stages(spark, sf_dir):
    said = F.when(F.col("o_orderstatus") == "F", "Plant commissioned. Once it was under construction.").when(F.col("o_orderstatus") == "O", "Still under construction!\nIt had been planned.").otherwise("No word of it.")
    docs = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("text"))
    return A.lifecycle(docs, "o_orderkey", "text", PHASES).select("o_orderkey", "stage", "quote")


def kept_sentences(spark, sf_dir):
    """Two sentences an order, each with the line of its number as evidence; lines that were returned are no evidence."""
    say = lambda k: F.struct(F.concat(F.lit(f"sentence {k} of "), F.col("o_orderkey").cast("string")).alias("text"), F.array(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.lit(str(k)))).alias("evidence_ids"))
    summaries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(say(1), say(2)).alias("sentences"))
    valid = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence_id"))
    return A.filter_sentences(summaries, valid).select("id", F.array_join(F.transform("sentences", lambda s: s["text"]), "; ").alias("sentences"))


def site_points(spark, sf_dir):
    """A third of the customers have a point; the others have the centroid of their nation, if it has one."""
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("district"))
    points = sites.filter("site_id % 3 = 0").select("site_id", (F.col("site_id") / 8).alias("lon"), (F.col("site_id") / 4).alias("lat"))
    districts = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("district"), F.col("n_nationkey").cast("double").alias("lon"), (-F.col("n_nationkey")).cast("double").alias("lat"))
    return St.site_point(sites, points, districts)


def expired_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(F.col("source") == "src1", "full").otherwise("verify_then_purge").alias("retention_policy"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("fetched_at")
    )
    return G.expire_texts(rows, F.lit("2024-02-15").cast("date"), 30).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def run_counts(spark, sf_dir):
    """A run over the documents by source, where the store has the texts of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_key"), F.sha2("text", 256).alias("content_hash"))
    return K.run_counts(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))


def dead_letters(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 6).cast("int").alias("attempts"))
    return St.dead_letter(runs).select("event_id", "attempts")


def next_tries(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", Tm.next_try(F.col("ts"), F.col("event_id") % 6).alias("next_at"))


def cron_due(spark, sf_dir):
    """Events at whose local minute a schedule by their kind is due."""
    cron = F.when(F.col("event_type") == "view", "* 6-9,20 * * *").when(F.col("event_type") == "click", "*/15 * * * 1").when(F.col("event_type") == "signup", "0-29 * 1,15 1 *").otherwise("5 4 * * 7")
    rows = table(spark, sf_dir, "events").withColumn("local", Tm.local_time(F.col("ts")))
    return rows.select("event_id", Tm.cron_due(F.col("local"), cron).alias("due"))


def unresolved(spark, sf_dir):
    """Brief values that are placeholders still and have no excuse."""
    brief = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, "from_elsewhere").otherwise("set").alias("value"), "n_nationkey")
    excused = brief.filter("n_nationkey % 10 = 0").select("path")
    return C.unresolved(brief.drop("n_nationkey"), excused, ["from_elsewhere"])


def regressions(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") / 100).alias("before"), (F.col("n_nationkey") % 4 / 100).alias("fall"))
    now, then = rows.select("metric", (F.col("before") - F.col("fall")).alias("value")), rows.select("metric", F.col("before").alias("value"))
    return V.regressions(now, then, 0.025).select("metric")


def stage_accuracy(spark, sf_dir):
    """The stage of each user's first event as a guess at that of the last; users of one event have no guess."""
    from annalist.operators import events as E
    from annalist.plans.common import staged

    rows = staged(spark, sf_dir)
    gold = E.project_state(rows, ["user_id"], ["ts", "event_id"], ["stage"])
    guess = E.first_of(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "stage", "event_id").filter("event_id % 9 <> 0")
    return V.stage_accuracy(guess, gold, "user_id", "stage").select(F.round("accuracy", 9).alias("accuracy"), "projects", "predicted")


def coverage_ratio(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old, new = orders.filter("o_orderpriority <= '3'").select("o_orderkey"), orders.filter("o_totalprice > 100000").select("o_orderkey")
    return V.coverage_ratio(new, old, "o_orderkey").select(F.round("coverage", 9).alias("coverage"), "items", "matched")


def relationships(spark, sf_dir):
    """Each customer with its orders and their states, in order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    rows = P.relationship(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders=orders)
    return rows.select("c_custkey", F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), " ").alias("orders"))


def scored_parts(spark, sf_dir):
    """What each feature adds to a score."""
    rows = table(spark, sf_dir, "customer").withColumn("x", S.score({"c_acctbal": 0.01, "c_nationkey": 2.0}))
    return rows.select("c_custkey", F.round("x.score", 6).alias("score"), F.round(F.col("x.parts")["c_nationkey"], 6).alias("nation_part"))


QUERIES = {f.__name__: f for f in (
    parsed_values, value_in_quote, normalised_texts, name_keys, robots_allowed, external_matches, mention_candidates, resolve_decisions, merged_ids, split_ids,
    extracted_claims, guarded_claims, quarantined_claims, payload_checks, classified, lifecycle_stages, kept_sentences, site_points, expired_texts, run_counts,
    dead_letters, next_tries, cron_due, unresolved, regressions, stage_accuracy, coverage_ratio, relationships, scored_parts,
)}

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1))"
_QUOTE = f"'Order ' || o_orderkey || ' was placed for $' || {_CENTS} || 'k.'"
_FOLLOW = """
    r AS (SELECT entity_id, merged_into AS goal FROM m UNION ALL SELECT r.entity_id, m.merged_into FROM r JOIN m ON m.entity_id = r.goal)
    SELECT entity_id, goal AS canonical_id FROM r WHERE goal NOT IN (SELECT entity_id FROM m)
"""
_MERGES = "SELECT c_custkey AS entity_id, c_custkey // 3 AS merged_into FROM customer WHERE c_custkey % 4 <> 0"
_GRAMS = "list_distinct([substr('  ' || lower({0}) || ' ', CAST(i AS BIGINT), 3) FOR i IN range(1, length({0}) + 2)])"
SQL = {
    "parsed_values": f"""
        SELECT o_orderkey, CAST({_CENTS} AS DOUBLE) * 1000000 AS amount, 'EUR' AS currency, CAST(o_custkey % 90 * 10 + 5 AS DOUBLE) / 1000 AS share, CAST(o_orderdate AS DATE) AS day,
            CAST(o_orderkey * 1000 AS DOUBLE) AS units FROM orders
    """,
    "value_in_quote": "SELECT o_orderkey, o_orderkey % 2 = 0 AS found FROM orders",
    "normalised_texts": "SELECT doc_id, sha256(regexp_replace(nfc_normalize(replace(text || 'é ' || chr(13) || chr(10) || 'end' || chr(13), 'a', 'ä')), '\\r\\n?', chr(10), 'g')) AS text_sha256 FROM documents",
    "name_keys": "SELECT c_custkey, lower(replace(c_name, '#', ' ')) || ' mining' AS name_key FROM customer",
    "robots_allowed": "SELECT page_id, NOT starts_with(p, '/en/') OR starts_with(p, '/en/1') AS allowed FROM (SELECT page_id, regexp_extract(url, '://[^/]+([^?#]*)', 1) AS p FROM pages)",
    "external_matches": "SELECT c_custkey AS mention_id, s_suppkey AS entity_id FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10",
    "mention_candidates": f"""
        WITH m AS (SELECT p_partkey AS mention_id, {_GRAMS.format("('x' || p_name)")} AS a FROM part WHERE p_partkey % 100 = 0),
        e AS (SELECT min(p_partkey) AS entity_id, {_GRAMS.format("p_name")} AS b FROM part GROUP BY p_name),
        s AS (SELECT mention_id, entity_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS j FROM m, e)
        SELECT mention_id, entity_id, round(j, 9) AS confidence, row_number() OVER (PARTITION BY mention_id ORDER BY j DESC, entity_id) AS rank FROM s WHERE j >= 0.5
        QUALIFY rank <= 3
    """,
    "resolve_decisions": """
        SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN c_nationkey END AS entity_id,
            CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 10 = 0 THEN 0.7::DOUBLE WHEN c_custkey % 2 = 0 THEN 0.95::DOUBLE END AS confidence,
            CASE WHEN c_custkey % 3 = 0 THEN 'match' WHEN c_custkey % 2 <> 0 THEN 'new' WHEN c_custkey % 4 = 0 OR c_custkey % 10 = 0 THEN 'review' ELSE 'match' END AS decision
        FROM customer
    """,
    "merged_ids": f"WITH RECURSIVE m AS ({_MERGES}), {_FOLLOW}",
    "split_ids": f"WITH RECURSIVE m AS ({_MERGES} AND c_custkey % 5 <> 0), {_FOLLOW}",
    "extracted_claims": f"""
        SELECT o_orderkey AS source_id, 'order_value' AS predicate, CAST({_CENTS} AS DOUBLE) * 1000 AS value, 'USD' AS currency, 'stated' AS certainty, 0 AS char_start, CAST(length({_QUOTE}) AS INT) AS char_end,
            {_QUOTE} AS quote, sha256({_QUOTE}) AS quote_hash FROM orders
    """,
    "guarded_claims": "SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown_predicate' WHEN o_orderkey % 3 = 0 THEN 'bad_span' WHEN o_orderkey % 5 = 0 THEN 'value_not_in_quote' END AS reason_code FROM orders",
    "quarantined_claims": """
        SELECT o_orderkey, '{"stage": ' || CASE WHEN o_orderkey % 8 = 0 THEN '"four"' ELSE '4' END || '}' AS output, CASE WHEN o_orderkey % 8 = 0 THEN 'bad_payload' END AS reason_code FROM orders
    """,
    "payload_checks": "SELECT event_id, event_id % 4 = 3 AS ok FROM events",
    "classified": """
        WITH w AS (SELECT doc_id, string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}\\s]+', ' ', 'g')), '\\s+') AS w FROM documents),
        c AS (SELECT doc_id, list_filter(['article', 'joining'], lambda c: CASE c WHEN 'article' THEN list_has_any(w, ['the', 'la', 'der']) ELSE list_has_any(w, ['and', 'et', 'und']) END) AS c FROM w)
        SELECT doc_id, array_to_string(c, ' ') AS codes, len(c) > 0 AS in_scope FROM c
    """,
    "lifecycle_stages": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 9 ELSE 6 END AS stage, CASE o_orderstatus WHEN 'F' THEN 'Plant commissioned.' ELSE 'Still under construction!' END AS quote
        FROM orders WHERE o_orderstatus IN ('F', 'O')
    """,
    "kept_sentences": """
        WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <= 2)
        SELECT o_orderkey AS id, coalesce(string_agg('sentence ' || k || ' of ' || o_orderkey, '; ' ORDER BY k) FILTER (WHERE k IS NOT NULL), '') AS sentences
        FROM orders LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY o_orderkey
    """,
    "site_points": """
        SELECT c_custkey AS site_id, c_nationkey AS district, CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 8 WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS lon,
            CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 4 WHEN c_nationkey % 5 <> 0 THEN CAST(-c_nationkey AS DOUBLE) END AS lat,
            CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_nationkey % 5 <> 0 THEN true END AS approximate FROM customer
    """,
    "expired_texts": "SELECT doc_id, CASE WHEN source = 'src1' OR doc_id % 60 + 30 >= 45 THEN sha256(text) END AS text_sha256 FROM documents",
    "run_counts": """
        SELECT source AS source_key, count(*) AS documents, count(*) FILTER (WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)) AS added FROM documents GROUP BY source
    """,
    "dead_letters": "SELECT event_id, CAST(event_id % 6 AS INT) AS attempts FROM events WHERE event_type = 'error' AND event_id % 6 > 3",
    "next_tries": "SELECT event_id, CASE WHEN event_id % 6 <= 3 THEN ts + to_seconds(CAST(60 * 2 ** (event_id % 6 - 1) AS INT)) END AS next_at FROM events",
    "cron_due": """
        WITH e AS (SELECT event_id, event_type, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Africa/Lusaka' AS l FROM events)
        SELECT event_id, CASE event_type WHEN 'view' THEN hour(l) BETWEEN 6 AND 9 OR hour(l) = 20 WHEN 'click' THEN minute(l) % 15 = 0 AND dayofweek(l) = 1
            WHEN 'signup' THEN minute(l) < 30 AND day(l) IN (1, 15) AND month(l) = 1 ELSE minute(l) = 5 AND hour(l) = 4 AND dayofweek(l) = 0 END AS due FROM e
    """,
    "unresolved": "SELECT n_name AS path, 'from_elsewhere' AS value FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey % 10 <> 0",
    "regressions": "SELECT n_name AS metric FROM nation WHERE n_nationkey % 4 = 3",
    "stage_accuracy": """
        WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 8 WHEN 'error' THEN 10 END AS stage FROM events),
        g AS (SELECT user_id, arg_max(stage, (ts, event_id)) AS gold, arg_min(stage, (ts, event_id)) AS guess, arg_min(event_id, (ts, event_id)) AS id FROM s GROUP BY user_id)
        SELECT round(avg(CASE WHEN id % 9 <> 0 AND guess = gold THEN 1 ELSE 0 END), 9) AS accuracy, count(*) AS projects, count(*) FILTER (WHERE id % 9 <> 0) AS predicted FROM g
    """,
    "coverage_ratio": "SELECT round(count(*) FILTER (WHERE o_totalprice > 100000) / count(*), 9) AS coverage, count(*) AS items, count(*) FILTER (WHERE o_totalprice > 100000) AS matched FROM orders WHERE o_orderpriority <= '3'",
    "relationships": """
        SELECT c_custkey, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ' ' ORDER BY o_orderkey, o_orderstatus) FILTER (WHERE o_orderkey IS NOT NULL), '') AS orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    """,
    "scored_parts": "SELECT c_custkey, round(c_acctbal * 0.01 + c_nationkey * 2.0, 6) AS score, CAST(c_nationkey * 2 AS DOUBLE) AS nation_part FROM customer",
}
