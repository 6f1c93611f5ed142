"""Queries of panels as they were known at a time, and of the cards of a board."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.functions.geo import shape
from annalist.operators import panels as P
from annalist.operators.documents import allowed_by_patterns
from annalist.plans.common import table

#: Reads are as of this time; orders stand for deals and signals.
AT = "1997-01-01"
STAGES = ("O", "F", "P", "X")


def _at():
    return F.lit(AT).cast("timestamp_ntz")


def feed_as_of(spark, sf_dir):
    rows = P.feed(table(spark, sf_dir, "orders"), at=_at(), time="o_orderdate", o_orderpriority=["1-URGENT", "2-HIGH"])
    return rows.select("o_orderkey", "o_custkey")


def buyers_as_of(spark, sf_dir):
    """The least clerk priority that each customer had for each status of orders by then."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    roles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("name"), "o_orderdate")
    return P.buyers(customers, roles, "c_custkey", "role", "name", ["O", "F", "P"], at=_at(), time="o_orderdate")


def relationship_as_of(spark, sf_dir):
    """Customers with the urgent and the open orders that they had by then."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    part = lambda condition: orders.filter(condition).select("c_custkey", "o_orderkey", "o_orderdate")
    out = P.relationship(customers, "c_custkey", at=_at(), time="o_orderdate", urgent=part("o_orderpriority = '1-URGENT'"), open=part("o_orderstatus = 'O'"))
    keys = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["o_orderkey"])), " ")
    return out.select("c_custkey", keys("urgent").alias("urgent"), keys("open").alias("open"))


def evidence_as_of(spark, sf_dir):
    """Orders by then with the lines that they name."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.concat_ws("-", "o_orderkey", n.cast("string"))).alias("evidence_ids"))
    return P.with_evidence(orders, lines, "evidence_ids", "evidence_id", at=_at(), time="o_orderdate").select("o_orderkey", "evidence_id", "l_quantity")


def kanban_cards(spark, sf_dir):
    """The latest order of each customer by then, as cards by its status; the column of a status that no order has is there."""
    return P.kanban_cards(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", STAGES, ["o_totalprice"], at=_at(), time="o_orderdate")


def area_centres(spark, sf_dir):
    """Customers with a point, a rectangle, one with a hole, or two rectangles: kind, centre and size of their area."""
    k, x, y = F.col("c_custkey"), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 90).cast("double")
    box = lambda a, b, c, d: F.format_string("(%s %s, %s %s, %s %s, %s %s, %s %s)", a, b, c, b, c, d, a, d, a, b)
    wkt = (
        F.when(k % 5 == 0, F.format_string("POINT (%s %s)", x, y))
        .when(k % 5 == 1, F.format_string("POLYGON (%s)", box(x, y, x + 4, y + 2)))
        .when(k % 5 == 2, F.format_string("POLYGON (%s, %s)", box(x, y, x + 4, y + 2), box(x + 1, y + 0.5, x + 2, y + 1.5)))
        .when(k % 5 == 3, F.format_string("MULTIPOLYGON ((%s), (%s))", box(x, y, x + 1, y + 1), box(x + 2, y, x + 4, y + 1)))
        .otherwise("POLYGON EMPTY")
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", shape(wkt).alias("s"))
    return rows.select("c_custkey", "s.kind", *[F.round(f"s.{c}", 9).alias(c) for c in ("lon", "lat", "area")])


def robots_patterns(spark, sf_dir):
    """Pages by rules of their hosts with wildcards and ends."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url")).alias("host"), F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1).alias("path"))
    hosts = pages.select("host").distinct()
    given = [("/", True), ("/*?page=", False), ("/en/*5$", False), ("/de", False), ("/de/*2", True), ("/f_/", False), ("/*/1*0", True), ("/%", False)]
    rules = hosts.crossJoin(F.broadcast(spark.createDataFrame(given, "pattern string, allow boolean")))  # eight rules for each host
    return allowed_by_patterns(pages, rules).select("page_id", "allowed")


QUERIES = {f.__name__: f for f in (area_centres, robots_patterns, feed_as_of, buyers_as_of, relationship_as_of, evidence_as_of, kanban_cards)}

_THEN = f"o_orderdate <= TIMESTAMP '{AT}'"
SQL = {
    "area_centres": """
        WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 90 AS DOUBLE) AS y FROM customer)
        SELECT c_custkey, CASE k WHEN 0 THEN 'point' WHEN 1 THEN 'polygon' WHEN 2 THEN 'polygon' WHEN 3 THEN 'multipolygon' END AS kind,
            round(CASE k WHEN 0 THEN x WHEN 1 THEN x + 2 WHEN 2 THEN x + (8 * 2 - 1 * 1.5) / 7 WHEN 3 THEN x + (1 * 0.5 + 2 * 3) / 3 END, 9) AS lon,
            round(CASE k WHEN 0 THEN y WHEN 1 THEN y + 1 WHEN 2 THEN y + 1 WHEN 3 THEN y + 0.5 END, 9) AS lat,
            CASE k WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 7 WHEN 3 THEN 3 END AS area
        FROM c
    """,
    "robots_patterns": """
        WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
        r(likes, n, allow) AS (VALUES ('/%', 1, true), ('/%?page=%', 8, false), ('/en/%5', 7, false), ('/de%', 3, false), ('/de/%2%', 6, true), ('/f\\_/%', 4, false), ('/%/1%0%', 6, true), ('/\\%%', 2, false)),
        m AS (SELECT page_id, arg_max(allow, (n, allow)) AS allow FROM p JOIN r ON path LIKE likes ESCAPE '\\' GROUP BY page_id)
        SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m USING (page_id)
    """,
    "feed_as_of": f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND {_THEN}",
    "buyers_as_of": f"""
        SELECT c_custkey, min(o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS "O", min(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS "F", min(o_orderpriority) FILTER (WHERE o_orderstatus = 'P') AS "P"
        FROM customer LEFT JOIN (SELECT * FROM orders WHERE {_THEN}) ON o_custkey = c_custkey GROUP BY c_custkey
    """,
    "relationship_as_of": f"""
        SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT'), '') AS urgent,
            coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O'), '') AS open
        FROM customer LEFT JOIN (SELECT * FROM orders WHERE {_THEN}) ON o_custkey = c_custkey GROUP BY c_custkey
    """,
    "evidence_as_of": f"SELECT o_orderkey, l_orderkey || '-' || l_linenumber AS evidence_id, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 AND {_THEN}",
    "kanban_cards": f"""
        WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max((o_orderdate, o_orderkey)) AS k FROM orders WHERE {_THEN} GROUP BY o_custkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k DESC, o_custkey) AS rank FROM l)
        SELECT b.place, b.stage AS o_orderstatus, rank, o_custkey, o_totalprice FROM (VALUES (0, 'O'), (1, 'F'), (2, 'P'), (3, 'X')) b(place, stage) LEFT JOIN r ON r.s = b.stage
    """,
}
