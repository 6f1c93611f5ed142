import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.operators import documents as D
from annalist.operators import resolve as R
from annalist.sources import config, feeds, store
from annalist.streaming import streams

RSS = """<rss><channel><title>News</title><item><title>One</title><link>http://a/1</link><description>First</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title>Two</title><link>http://a/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Log</title><entry><title>Three</title><link href="http://b/3"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>"""


def test_feeds_and_a_broken_one(spark, tmp_path):
    for name, content in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<rss>")):
        (tmp_path / name).write_text(content)
    rows = {(r.feed, r.title): r for r in feeds.read_feed(spark, str(tmp_path)).collect()}
    assert rows["a.xml", "One"].published_at == dt.datetime(2024, 1, 1, 8)
    assert rows["b.xml", "Three"].url == "http://b/3"
    assert rows["c.xml", None].error
    items = feeds.read_news_items(spark, str(tmp_path)).collect()
    assert {r.retention_policy for r in items} == {"link_only"} and len(items) == 3


def test_briefs(spark, tmp_path):
    (tmp_path / "brief.yaml").write_text(
        """
- id: v1
  activated_at: 2024-01-01T00:00:00Z
  sources: [{type: rss, url: http://a, cron: daily, licence_code: full}]
  keywords: [diesel]
  gaps: [tender]
- id: v2
  activated_at: 2024-02-01T00:00:00Z
  sources: []
"""
    )
    briefs = config.load_brief(spark, str(tmp_path / "brief.yaml"))
    at = lambda t: F.lit(t).cast("timestamp")
    assert config.active_brief(briefs, at("2024-01-15")).first().id == "v1"
    stamped = config.stamp_brief(spark.range(2), config.active_brief(briefs, at("2024-03-01")))
    assert {r.brief_version_id for r in stamped.collect()} == {"v2"}
    types = spark.createDataFrame([("rss",), ("tender",), ("permit",)], "type string")
    assert [r.type for r in config.uncovered(types, config.brief_sources(briefs), config.known_gaps(briefs)).collect()] == ["permit"]
    grown = config.accept_source(briefs, "v1", "v3", "2024-03-01", ("web", "http://c", "weekly", "x")).first()
    assert grown.id == "v3" and len(grown.sources) == 2


def test_robots_spans_and_policies(spark):
    rules = spark.createDataFrame([("h", "/", True), ("h", "/private", False), ("h", "/private/open", True)], "host string, prefix string, allow boolean")
    asked = spark.createDataFrame([("h", "/a"), ("h", "/private/x"), ("h", "/private/open/y"), ("other", "/private")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in D.allowed(asked, rules).collect()} == {("h", "/a"): True, ("h", "/private/x"): False, ("h", "/private/open/y"): True, ("other", "/private"): True}
    sources = spark.createDataFrame([("s", "héllo wörld")], "source_id string, text string")
    spans = [("s", 0, 5, "héllo"), ("s", 1, 6, "héllo"), ("t", 0, 5, "héllo")]
    evidence = spark.createDataFrame(spans, "source_id string, char_start int, char_end int, quote string").withColumn("quote_hash", F.sha2("quote", 256))
    assert sorted(r.verified for r in D.verify_spans(evidence, sources).collect()) == [False, False, True]


def test_merge_chains(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "entity_id string, merged_into string")
    assert {r.entity_id: r.canonical_id for r in R.canonical_ids(merges).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}


def test_resolution_order(spark):
    step = lambda rows: spark.createDataFrame(rows, "mention_id string, entity_id string, confidence double")
    mentions = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m4",)], "mention_id string")
    out = R.decide(mentions, step([("m1", "e1", 1.0)]), step([("m1", "e9", 1.0), ("m2", "e2", 0.95), ("m4", "e4", 0.95), ("m4", "e5", 0.9)]))
    assert {r.mention_id: (r.entity_id, r.decision) for r in out.collect()} == {"m1": ("e1", "match"), "m2": ("e2", "match"), "m3": (None, "new"), "m4": ("e4", "review")}


def test_site_points_are_never_invented(spark):
    sites = spark.createDataFrame([("s1", "d1"), ("s2", "d1"), ("s3", "d9")], "site_id string, district string")
    points = spark.createDataFrame([("s1", 1.0, 2.0)], "site_id string, lon double, lat double")
    districts = spark.createDataFrame([("d1", 5.0, 6.0)], "district string, lon double, lat double")
    assert {r.site_id: (r.lon, r.approximate) for r in store.site_point(sites, points, districts).collect()} == {"s1": (1.0, False), "s2": (5.0, True), "s3": (None, None)}


def test_collection_is_incremental_and_a_second_run_adds_nothing(spark, tmp_path):
    inbox, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, text string, fetched_at timestamp"
    at = dt.datetime(2024, 1, 1)

    def put(*rows):
        spark.createDataFrame([(u, t, at) for u, t in rows], schema).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        streams.ingest_stream(spark.readStream.schema(schema).parquet(inbox), target, str(tmp_path / "ck")).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(target).collect())

    put(("u1", "one"), ("u2", "one"), ("u3", "two"))
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    put(("u4", "two"), ("u5", "three"))
    assert run() == ["one", "three", "two"]


def test_projection_stream_and_alerts(spark, tmp_path):
    log, target = str(tmp_path / "log"), str(tmp_path / "state")
    schema = "id string, k string, sequence long, v string, tier int, supersedes_event_id string, recorded_at timestamp"
    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)

    def put(*rows):
        spark.createDataFrame([(*r, None, at(r[2])) for r in rows], schema).coalesce(1).write.mode("append").parquet(log)

    def run():
        events = streams.event_stream(spark, log, schema)
        streams.project_stream(events, lambda: spark.read.schema(schema).parquet(log), target, str(tmp_path / "ck"), ["k"], ["v"]).awaitTermination()
        return {r.k: r.v for r in streams.read_projection(spark, target, ["k"]).collect()}

    put(("a", "x", 1, "old", 0), ("b", "y", 1, "only", 1))
    assert run() == {"x": "old", "y": "only"}
    put(("c", "x", 2, "new", 1))
    assert run() == {"x": "new", "y": "only"}
    streams.raise_alerts(streams.event_stream(spark, log, schema), str(tmp_path / "alerts"), str(tmp_path / "ck2")).awaitTermination()
    assert [(r.id, r.status) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == [("a", "unconfirmed")]


def test_live_counts(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "e"))
    rows = streams.counts_by_window(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), "ts", "event_type")
    query = rows.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM live").first().n == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("days", [0, 30])
def test_expiry_keeps_hashes(spark, days):
    from annalist.operators.govern import expire_texts

    rows = spark.createDataFrame([("verify_then_purge", dt.datetime(2024, 1, 1), "t", "h"), ("full", dt.datetime(2024, 1, 1), "t", "h")], "retention_policy string, fetched_at timestamp, text string, content_hash string")
    out = {r.retention_policy: (r.text, r.content_hash) for r in expire_texts(rows, F.lit("2024-01-15").cast("date"), days).collect()}
    assert out == {"verify_then_purge": (None if days == 0 else "t", "h"), "full": ("t", "h")}


def test_chain_verifies_after_a_person_is_erased(spark, tmp_path):
    from annalist.operators import govern as G

    keys = spark.createDataFrame([("p", b"0123456789abcdef"), ("q", b"fedcba9876543210")], "person_id string, key binary")
    people = spark.createDataFrame([("p", "Ann Lee"), ("q", "Bo Day")], "person_id string, name string").join(keys, "person_id")
    rows = people.select(
        F.concat(F.lit("e"), "person_id").alias("id"), F.lit("entity").alias("stream_type"), F.lit("s").alias("stream_id"), F.lit("ContactAdded").alias("event_type"),
        F.to_json(F.struct("person_id", G.seal(F.col("name"), F.col("key")).alias("name"))).alias("payload"), F.lit("human").alias("actor_type"), F.lit("ann").alias("actor_id"),
        F.lit(dt.datetime(2024, 1, 1)).alias("recorded_at"),
    )
    log = store.EventStore(spark, str(tmp_path / "log"))
    assert log.append_events(rows) == 0
    left = G.erase(keys, spark.createDataFrame([("p",)], "person_id string"))
    kept = log.read().select(F.get_json_object("payload", "$.person_id").alias("person_id"), F.get_json_object("payload", "$.name").alias("name"))
    assert {r.person_id: r.name for r in G.unseal(kept, left, ["name"]).collect()} == {"p": None, "q": "Bo Day"}
    assert log.chain_breaks().count() == 0 and log.cut_ends().count() == 0


def test_early_sources_of_a_brief(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("id: v1\nactivated_at: 2024-01-01 00:00:00\nsources:\n- {type: rss, url: http://a}\nearly_signal:\n- {type: permit, url: http://b}\n")
    found = config.brief_sources(config.load_brief(spark, str(tmp_path / "b.yaml"))).collect()
    assert [(r.type, r.url, r.early) for r in found] == [("rss", "http://a", False), ("permit", "http://b", True)]
    (tmp_path / "c.yaml").write_text("id: v2\nearly_signal:\n- {type: permit, url: http://b}\n")
    assert [r.early for r in config.brief_sources(config.load_brief(spark, str(tmp_path / "c.yaml"))).collect()] == [True]


def test_found_documents_become_sources_once(spark, tmp_path):
    """Hash, fingerprint, language and policy of each text; every address once; a second run adds nothing; texts expire."""
    schema = "url string, text string, fetched_at timestamp, licence_code string"
    at = dt.datetime(2024, 1, 1)
    rows = [("u1", "the cat and the dog", at, "open"), ("u2", "the cat and the dog", at, "open"), ("u3", "der Hund und die Katze", at, "odd"), ("u4", None, at, None), ("u5", "the mine", at, "open")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = store.tables(spark, str(tmp_path / "store"))
    for ck in ("ck", "again"):
        streams.source_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), kept["sources"], kept["source_urls"], {"open": "full"}, str(tmp_path / ck), "b1").awaitTermination()
    found = {r.url: r for r in kept["sources"].read().collect()}
    assert sorted(found) == ["u1", "u3", "u4", "u5"] and kept["sources"].read().count() == 4
    assert (found["u1"].language, found["u3"].language, found["u1"].retention_policy, found["u3"].retention_policy) == ("en", "de", "full", "verify_then_purge")
    assert found["u1"].simhash is not None and found["u4"].simhash is None and found["u1"].brief_version_id == "b1"
    urls = sorted((r.source_id, r.url) for r in kept["source_urls"].read().collect())
    assert len(urls) == 5 and [u for i, u in urls if i == found["u1"].id] == ["u1", "u2"]

    store.write_texts(kept["texts"], kept["sources"].read().select(F.col("id").alias("source_id"), F.lit("text").alias("text")))
    store.purge_texts(kept["texts"].read(), kept["sources"].read(), F.lit("2024-03-01").cast("date"), 30, str(tmp_path / "left"))
    left = {r.source_id: r for r in spark.read.parquet(str(tmp_path / "left")).collect()}
    assert left[found["u1"].id].text == "text" and left[found["u3"].id].text is None and left[found["u3"].id].content_hash is not None


def test_alerts_are_events_of_the_store(spark, tmp_path):
    schema = "id string, stream_type string, stream_id string, tier int, evidence_ids array<string>, recorded_at timestamp"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", "entity", "p1", 0, ["e"], at), ("b", "entity", "p1", 1, ["e"], at), ("c", "entity", "p2", 0, ["e"], at)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    log = store.EventStore(spark, str(tmp_path / "store"))
    for ck in ("ck", "again"):
        streams.raise_alerts(streams.event_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "alerts"), str(tmp_path / ck), store=log).awaitTermination()
    assert log.quarantine.read().count() == 0
    assert sorted((r.stream_id, r.event_type, r.sequence) for r in log.read().collect()) == [("p1", "AlertRaised", 1), ("p2", "AlertRaised", 1)]
    assert log.chain_breaks().count() == 0
