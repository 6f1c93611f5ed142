"""Sources and evidence: duplicates, spans, licences, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as X

#: Blocks of 10 of a fingerprint's 60 bits: three bits touch three of the six at most, so pairs within three bits share three.
BLOCKS = tuple(10 * k for k in range(6))


def simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash): 60 bits, each set where more than half of the words have it; null without words.

    Words are counted in one grouping, before the shuffle. Each of its 30 sums holds the counts of two bits, 30 bits apart: a
    text of at most 2 GB has fewer than 2^30 words, so neither count reaches the other.
    """
    tokens = docs.select(key, F.explode_outer(F.transform(X.words(F.col(text)), X.token_bits)).alias("h"))
    low = (1 << 30) - 1
    two = lambda k: F.shiftright("h", k).bitwiseAND(F.lit(1 << 30 | 1).cast("long"))
    sums = tokens.groupBy(key).agg(F.count("h").alias("n"), *[F.sum(two(k)).alias(f"b{k}") for k in range(30)])
    count = lambda k: F.col(f"b{k}").bitwiseAND(F.lit(low).cast("long")) if k < 30 else F.shiftright(f"b{k - 30}", 30)
    bits = [F.when(2 * count(k) > F.col("n"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(60)]
    value = sum(bits[1:], bits[0])
    return sums.select(key, F.when(F.col("n") > 0, value).alias("simhash"))


def near_fingerprints(prints: DataFrame, column: str = "simhash", within: int = 3) -> DataFrame:
    """(a, b): distinct fingerprints, a < b, that differ in at most ``within`` (3 at most) bits.

    They meet by an equi-join on the values of three blocks of ten bits, for each of the 20 choices of three; of the choices that
    a pair shares, the first counts. The join is by shuffle, whatever Spark takes the sides' size for: it knows that of the
    fingerprints, which become 20 rows each afterwards.
    """
    if within > 3:
        raise ValueError("three of six blocks find pairs within three bits")
    distinct = prints.filter(F.col(column).isNotNull()).select(F.col(column).alias("p")).distinct()
    masks = [sum(0x3FF << s for s in chosen) for chosen in combinations(BLOCKS, 3)]
    cuts = F.array(*[F.struct(F.lit(k).alias("block"), F.col("p").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(masks)])
    blocks = distinct.select("p", F.explode(cuts).alias("x")).select("p", "x.block", "x.value")
    left, right = blocks.withColumnRenamed("p", "a"), blocks.withColumnRenamed("p", "b").hint("merge")
    return left.join(right, ["block", "value"]).filter((F.col("a") < F.col("b")) & (X.hamming(F.col("a"), F.col("b")) <= within)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str, text: str, within: int = 3) -> DataFrame:
    """Every document with its fingerprint, class_id (least key with this fingerprint) and n_links (other fingerprints near)."""
    prints = simhash(docs, key, text)
    pairs = near_fingerprints(prints, within=within)
    links = pairs.select(F.col("a").alias("simhash")).unionAll(pairs.select(F.col("b").alias("simhash"))).groupBy("simhash").agg(F.count(F.lit(1)).alias("n_links"))
    classes = prints.groupBy("simhash").agg(F.min(key).alias("class_id")).join(links, "simhash", "left").withColumnRenamed("simhash", "__print")
    joined = prints.join(classes, F.col("simhash") == F.col("__print"), "left")
    return joined.select(key, "simhash", F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def exact_duplicates(docs: DataFrame, key: str, text: str, order: Sequence[str]) -> DataFrame:
    """(key, content_hash, duplicate_of): the first document with the same text, null for the first itself."""
    rows = docs.select(key, *[c for c in order if c != key], X.content_hash(F.col(text)).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min_by(key, F.struct(*order)).alias("first"))
    return rows.join(first, "content_hash").select(key, "content_hash", F.when(F.col("first") != F.col(key), F.col("first")).alias("duplicate_of"))


def source_urls(docs: DataFrame, hash_column: str, url: str) -> DataFrame:
    """The distinct urls of each content, sorted, and their number."""
    return docs.groupBy(hash_column).agg(F.array_sort(F.collect_set(url)).alias("urls"), F.count_distinct(url).alias("n_urls"))


def new_only(found: DataFrame, existing: DataFrame, key: str = "content_hash") -> DataFrame:
    return found.join(existing.select(key).distinct(), key, "left_anti")


def pending_jobs(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return sources.join(done.select(key).distinct(), key, "left_anti")


def verify_spans(evidence: DataFrame, sources: DataFrame, key: str = "source_id", text: str = "text") -> DataFrame:
    """Evidence (char_start, char_end, quote, quote_hash) with ``verified``: the quote is the text there and its hash fits."""
    joined = evidence.join(sources.select(key, F.col(text).alias("__text")), key, "left")
    there = X.span(F.col("__text"), F.col("char_start"), F.col("char_end")) == F.col("quote")
    fits = X.content_hash(F.col("quote")) == F.col("quote_hash")
    return joined.withColumn("verified", F.coalesce(there & fits & (F.length("quote") <= 500), F.lit(False))).drop("__text")


def unverified_facts(events: DataFrame, evidence: DataFrame, event_id: str, evidence_ids: str, evidence_id: str) -> DataFrame:
    """(event, evidence id) of events whose evidence is missing or not verified; an event that names none has a row with a null."""
    named = events.select(event_id, F.explode_outer(evidence_ids).alias("__e"))
    good = evidence.filter("verified").select(F.col(evidence_id).alias("__e")).distinct()
    return named.join(good, "__e", "left_anti").select(event_id, F.col("__e").alias(evidence_id))


def with_policy(sources: DataFrame, licences: Mapping[str, str], code: str, news: Column | None = None) -> DataFrame:
    """retention_policy by licence code: unknown codes are verified and purged, news items are links only."""
    table = F.create_map(*[F.lit(x) for pair in licences.items() for x in pair])
    policy = F.coalesce(F.try_element_at(table, F.col(code)), F.lit("verify_then_purge"))
    return sources.withColumn("retention_policy", policy if news is None else F.when(news, "link_only").otherwise(policy))


def display(sources: DataFrame, text: str = "text", n: int = 200) -> DataFrame:
    """``shown``: the whole text where the policy is full, else an excerpt of ``n`` characters."""
    return sources.withColumn("shown", F.when(F.col("retention_policy") == "full", F.col(text)).otherwise(X.excerpt(F.col(text), n)))


def unknown_codes(rows: DataFrame, code: str, known: Sequence[str]) -> DataFrame:
    return rows.filter(~F.col(code).isin(*known) | F.col(code).isNull())


def keyword_hits(rows: DataFrame, key: str, text: str, keywords: Sequence[str], exclusions: Sequence[str] = ()) -> DataFrame:
    """(key, hits): the keywords among the words of a text, sorted; none where an exclusion is among them."""
    tokens = X.words(F.col(text))
    hits = F.array_sort(F.array_intersect(F.array(*[F.lit(k) for k in keywords]), tokens))
    barred = F.arrays_overlap(tokens, F.array(*[F.lit(k) for k in exclusions])) if exclusions else F.lit(False)
    return rows.select(key, hits.alias("hits"), barred.alias("barred")).filter((F.size("hits") > 0) & ~F.col("barred")).select(key, "hits")


def page_map(pages: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Each page with the offset at which its text starts in its document."""
    before = F.sum(F.length(F.coalesce(text, F.lit("")))).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return pages.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long"))


def page_of(offset: Column, starts: Column) -> Column:
    """The page (from 1) that an offset is on, given the starts of all pages."""
    return F.size(F.filter(starts, lambda p: p <= offset)).cast("long")


def fetch_plan(requests: DataFrame, url: str, never: Sequence[str]) -> DataFrame:
    """``read_at_source``: false for hosts (and hosts under them) that are never fetched; their item text is used instead."""
    host = X.domain(F.col(url))
    barred = F.lit(False)
    for h in never:
        barred = barred | (host == h) | host.endswith("." + h)
    return requests.withColumn("host", host).withColumn("read_at_source", ~barred)


def allowed(requests: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``allowed`` by robots rules (host, prefix, allow): the longest prefix decides, allow wins a tie, no rule allows.

    Joined by host; a host's rules are one array.
    """
    by_host = rules.groupBy(host).agg(F.collect_set(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("__rules"))
    joined = requests.join(by_host, host, "left")
    best = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col(path), r["prefix"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__rules")


def robots_match(path: Column, pattern: Column) -> Column:
    """Whether a path begins as a robots pattern says: ``*`` stands for any characters, a last ``$`` for the end of the path."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    return F.rlike(path, F.concat(F.lit("(?s)^\\Q"), quoted, F.when(ends, F.lit("\\E$")).otherwise(F.lit("\\E"))))


def allowed_by_patterns(requests: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", agent: str | None = None) -> DataFrame:
    """``allowed`` by robots rules (host, pattern, allow) with ``*`` and ``$``: the longest pattern that fits decides, allow wins a tie,
    no rule allows. Null and empty patterns are no rules.

    With ``agent``, rules have a column agent: of a host those of this agent alone count (whatever its case), if it has any, else
    those of ``*``. Joined by host; a host's rules are one array, so requests are not multiplied.
    """
    known = rules.filter(F.length("pattern") > 0)
    if agent is not None:
        own = known.filter(F.lower("agent") == agent.lower())
        known = own.unionByName(known.filter(F.col("agent") == "*").join(own.select(host).distinct(), host, "left_anti"))
    by_host = known.groupBy(host).agg(F.collect_set(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("__rules"))
    joined = requests.join(by_host, host, "left")
    best = F.array_max(F.filter("__rules", lambda r: robots_match(F.col(path), r["pattern"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__rules")
