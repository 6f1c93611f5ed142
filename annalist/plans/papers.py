"""Queries over sources and evidence; documents, benchmark, pages and conversations stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators import documents as D
from annalist.operators import mentions as M
from annalist.operators import timing as Tm
from annalist.plans.common import table

LICENCES = {"src0": "full", "src1": "full", "src2": "link_only", "src3": "link_only", "src4": "verify_then_purge"}
KEYWORDS, EXCLUSIONS = ("the", "of", "and", "la", "der"), ("worthless", "trash")
NEVER = ("example.net", "m.free-bets.example.com")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def exact_duplicates(spark, sf_dir):
    return D.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text", ["doc_id"])


def duplicate_canonical(spark, sf_dir):
    """The first copy by (source, doc_id) is the canonical one."""
    return D.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text", ["source", "doc_id"]).select("doc_id", "duplicate_of")


def source_urls(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(X.content_hash(F.col("text")).alias("content_hash"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"))
    return D.source_urls(rows, "content_hash", "url").select("content_hash", F.array_join("urls", " ").alias("urls"), "n_urls")


def pending_jobs(spark, sf_dir):
    return D.pending_jobs(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


def new_only(spark, sf_dir):
    """A second run over the same documents finds only the texts that the labelled ones lack."""
    rows = _docs(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    known = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return D.new_only(rows, known)


def simhash_pairs(spark, sf_dir):
    """Every document with its class of equal fingerprints and how many other fingerprints are within three bits."""
    return D.near_duplicates(_docs(spark, sf_dir), "doc_id", "text")


def _evidence(spark, sf_dir):
    """Quotes of 60 characters at 10, every third with a wrong offset and every fifth with a wrong hash."""
    quote = F.substring("text", 11, 60)
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "text", quote.alias("quote"))
    start = F.when(F.col("source_id") % 3 == 0, 11).otherwise(10)
    digest = F.when(F.col("source_id") % 5 == 0, F.sha2(F.lit("wrong"), 256)).otherwise(F.sha2("quote", 256))
    return rows.select("source_id", start.alias("char_start"), (start + F.length("quote")).alias("char_end"), "quote", digest.alias("quote_hash"))


def span_verification(spark, sf_dir):
    sources = _docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "text")
    return D.verify_spans(_evidence(spark, sf_dir), sources).select("source_id", "char_start", "char_end", "verified")


def passage_places(spark, sf_dir):
    """All places of benchmark passages in documents, code points from 0."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("name"))
    found = M.find_names(_docs(spark, sf_dir), items, "doc_id", "text", "name", whole_words=False, fold_case=False)
    return found.join(items, "name").select("doc_id", "item_id", F.col("start").cast("long").alias("char_start"), F.col("end").cast("long").alias("char_end"))


def passage_spans(spark, sf_dir):
    """Where benchmark passages stand in documents first."""
    first = passage_places(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.min(F.struct("char_start", "char_end")).alias("at"))
    return first.select("doc_id", "item_id", "at.char_start", "at.char_end")


def licence_display(spark, sf_dir):
    rows = D.with_policy(_docs(spark, sf_dir), LICENCES, "source", F.col("lang") == "es")
    shown = D.display(rows, n=80)
    return shown.select("doc_id", "retention_policy", F.sha2("shown", 256).alias("shown_sha256"), F.length("shown").cast("long").alias("n_shown"))


def excerpt(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.excerpt(F.col("text"), 120).alias("excerpt"))


def code_checks(spark, sf_dir):
    bad = D.unknown_codes(_docs(spark, sf_dir), "lang", ["en", "de"])
    return bad.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def keyword_hits(spark, sf_dir):
    hits = D.keyword_hits(_docs(spark, sf_dir), "doc_id", "text", KEYWORDS, EXCLUSIONS)
    return hits.select("doc_id", F.array_join("hits", " ").alias("hits"))


def fetch_plan(spark, sf_dir):
    return D.fetch_plan(table(spark, sf_dir, "pages"), "url", NEVER).select("page_id", "host", "read_at_source")


def fetch_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("host", X.domain(F.col("url")))
    return Tm.slots(rows, "host", ["page_id"]).select("page_id", "wait_s")


def page_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(X.domain(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def page_map(spark, sf_dir):
    return D.page_map(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "char_start")


def page_of(spark, sf_dir):
    """The turn that the middle of a conversation's text falls in."""
    rows = D.page_map(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    starts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("char_start")).alias("starts"), F.sum(F.length("text")).alias("n"))
    return starts.select("conv_id", F.floor(F.col("n") / 2).alias("offset"), D.page_of(F.floor(F.col("n") / 2), F.col("starts")).alias("page"))


def page_text(spark, sf_dir):
    from annalist.sources.web import main_text

    return main_text(table(spark, sf_dir, "pages"), "page_id", "html")


def language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.detect_language(F.col("text")).alias("language"))


QUERIES = {f.__name__: f for f in (
    exact_duplicates, duplicate_canonical, source_urls, pending_jobs, new_only, simhash_pairs, span_verification, passage_places, passage_spans, licence_display, excerpt,
    code_checks, keyword_hits, fetch_plan, fetch_slots, page_domain, page_map, page_of, page_text, language,
)}

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1))"
SQL = {
    "exact_duplicates": "SELECT doc_id, sha256(text) AS content_hash, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)",
    "duplicate_canonical": "SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY text ORDER BY source, doc_id) AS first FROM documents)",
    "source_urls": "SELECT sha256(text) AS content_hash, string_agg(u, ' ' ORDER BY u) AS urls, count(*) AS n_urls FROM (SELECT DISTINCT text, source || '/' || doc_id AS u FROM documents) GROUP BY text",
    "pending_jobs": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "new_only": "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))",
    "simhash_pairs": f"""
        WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
        h AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 1, 15) AS BIGINT) AS h FROM w),
        f AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k} ELSE 0 END" for k in range(60))} AS simhash FROM h GROUP BY doc_id),
        c AS (SELECT CAST(simhash AS BIGINT) AS simhash, min(doc_id) AS class_id FROM f GROUP BY simhash),
        n AS (SELECT a.simhash, count(*) AS n_links FROM c a JOIN c b ON a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY a.simhash)
        SELECT d.doc_id, c.simhash, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n.n_links, 0) AS n_links
        FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.simhash = f.simhash LEFT JOIN n ON n.simhash = c.simhash
    """,
    "span_verification": """
        WITH e AS (SELECT doc_id AS source_id, text, substr(text, 11, 60) AS quote, CASE WHEN doc_id % 3 = 0 THEN 11 ELSE 10 END AS char_start FROM documents)
        SELECT source_id, char_start, char_start + length(quote) AS char_end, substr(text, char_start + 1, length(quote)) = quote AND source_id % 5 <> 0 AS verified FROM e
    """,
    "passage_places": """
        WITH m AS (SELECT doc_id, item_id, d.text AS t, b.text AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
        a AS (SELECT *, unnest(range(1, length(t) - length(p) + 2)) AS pos FROM m)
        SELECT doc_id, item_id, pos - 1 AS char_start, pos - 1 + length(p) AS char_end FROM a WHERE substr(t, pos, length(p)) = p
    """,
    "passage_spans": "SELECT doc_id, item_id, instr(d.text, b.text) - 1 AS char_start, instr(d.text, b.text) - 1 + length(b.text) AS char_end FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "licence_display": """
        WITH p AS (SELECT *, CASE WHEN lang = 'es' THEN 'link_only' WHEN source IN ('src0', 'src1') THEN 'full' WHEN source IN ('src2', 'src3') THEN 'link_only' ELSE 'verify_then_purge' END AS retention_policy FROM documents),
        s AS (SELECT doc_id, retention_policy, CASE WHEN retention_policy = 'full' THEN text ELSE substr(text, 1, 80) END AS shown FROM p)
        SELECT doc_id, retention_policy, sha256(shown) AS shown_sha256, length(shown) AS n_shown FROM s
    """,
    "excerpt": "SELECT doc_id, substr(text, 1, 120) AS excerpt FROM documents",
    "code_checks": "SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL GROUP BY lang",
    "keyword_hits": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
        h AS (SELECT doc_id, list_sort(list_filter(['the', 'of', 'and', 'la', 'der'], lambda k: list_contains(w, k))) AS h FROM w WHERE NOT list_has_any(w, ['worthless', 'trash']))
        SELECT doc_id, array_to_string(h, ' ') AS hits FROM h WHERE len(h) > 0
    """,
    "fetch_plan": f"SELECT page_id, host, NOT (host = 'example.net' OR host LIKE '%.example.net' OR host = 'm.free-bets.example.com' OR host LIKE '%.m.free-bets.example.com') AS read_at_source FROM (SELECT page_id, {_HOST} AS host FROM pages)",
    "fetch_slots": f"SELECT page_id, 5 * (row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1) AS wait_s FROM pages",
    "page_domain": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1",
    "page_map": "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations",
    "page_of": """
        WITH m AS (SELECT conv_id, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(length(text)) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT conv_id, CAST(any_value(n) // 2 AS BIGINT) AS "offset", count(*) FILTER (WHERE s <= n // 2) AS page FROM m GROUP BY conv_id
    """,
}
