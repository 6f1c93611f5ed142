"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Texts are words: runs of letters and digits, lower-cased. For each benchmark item the documents' windows of the item's size
are compared with it:

1. Seeds: a window that shares no shingle with an item has similarity 0, so only windows laid where a shingle of an item
   occurs are made (its place in the document less its place in the item), and the windows between two such starts of an
   item where its parts may stand in another order. Of N shingles, a window at the threshold t shares 2tN / (1 + t) at least,
   so there are as many hits, and the nearest starts around it are at most 2N / (1 + t) apart; a window with all starts on
   one side is no better than the nearest of them. Nothing is lost by this. Shingles are joined by their 64-bit keys; the
   benchmark's side is broadcast only while it has at most ``broadcast_seeds`` rows.
2. A window gets a 64-bit SimHash of its words. Fingerprints are cut in ``radius + 1`` blocks; two within ``radius`` bits of
   one another agree in one block at least, so an equi-join on (item, block, value) finds every pair within the radius, of a
   window and the items that it was laid for.
3. Candidates are verified exactly: multiplicity-weighted Jaccard similarity of the 5-word shingles of window and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import stored

WIDTH = 5


def _words(text: Column) -> Column:
    """The 64-bit keys of the words of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(words: Column, width: Column | int) -> Column:
    """Keys of all runs of ``width`` words, in order: the hash of the keys of the words."""
    last = F.size(words) - width
    if isinstance(width, int):  # no slices are made; the keys are the same
        run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
    else:
        run = lambda i: F.xxhash64(F.slice(words, i + 1, width))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>"))


def _numbered(shingles: Column) -> Column:
    """The shingles as a set: a repeated one counts with its number, so that set sizes are sums of multiplicities."""
    number = F.transform(shingles, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(shingles, F.lit(1), i), lambda y: y == x))))
    plain = F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0)))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(number)


def simhash(words: Column) -> Column:
    """64-bit SimHash of an array of word keys: a bit is set where more than half of them have it."""
    bit = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long"))
    ones = lambda b: F.aggregate(words, F.lit(0).cast("long"), lambda s, h: s + bit(h, b))
    value = lambda b: F.when(ones(b) * 2 > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(value(b)))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """(block, value) of the ``radius + 1`` blocks of a fingerprint."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    value = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("block"), value(a, b).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 19, broadcast_seeds: int = 1_000_000) -> DataFrame:
    """The benchmark items (item_id, text) that the documents (doc_id, text) contain.

    Returns a row for each pair: doc_id, item_id, similarity, start_word (where the best window starts, from 1; of
    equal ones, the earliest of those laid at a shingle), n_words (of the item). An item of fewer than five words is one shingle. A document shorter than an item is one
    window. Null and empty texts, and items without a word, match nothing. Repeated documents or items give one row for each
    pair of ids (the best one). Rows that share a doc_id are searched each for itself, by a hash of id and text; a null doc_id is
    an id like any other. Other columns are ignored; empty tables give an empty result. Whole texts of any length are searched.
    """
    own = F.xxhash64("doc_id", "text").alias("doc")
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    items = items.withColumn("len", F.size("words")).withColumn("width", F.least("len", F.lit(WIDTH))).withColumn("item", F.xxhash64("words"))
    items = items.withColumn("shingles", _shingles(F.col("words"), F.col("width"))).withColumn("item_print", simhash(F.col("words"))).drop("words")
    items = stored(items, "items")
    seeds = items.select("width", "len", "item", F.posexplode("shingles").alias("offset", "shingle")).distinct()
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [WIDTH]  # five numbers at most
    if seeds.count() <= broadcast_seeds:
        seeds = F.broadcast(seeds)
    texts = docs.select(own, _words(F.col("text")).alias("words"))
    shingles = {w: _shingles(F.col("words"), w) for w in widths}
    if len(widths) == 1:
        keys = texts.select("doc", F.size("words").alias("size"), F.lit(widths[0]).alias("width"), F.posexplode(shingles[widths[0]]).alias("at", "shingle"))
    else:  # all widths in one pass over the texts
        place = lambda width, found: F.transform(found, lambda x, i: F.struct(F.lit(width).alias("width"), i.alias("at"), x.alias("shingle")))
        placed = [place(w, k) for w, k in shingles.items()]
        keys = texts.select("doc", F.size("words").alias("size"), F.explode(F.concat(*placed)).alias("k")).select("doc", "size", "k.*")
    hits = keys.join(seeds, ["width", "shingle"])
    place = F.greatest(F.lit(1), F.least(F.col("at") - F.col("offset") + 1, F.col("size") - F.col("len") + 1))
    found = hits.select("doc", "item", "len", "width", "at", place.alias("start"))
    runs = found.groupBy("doc", "item", "len", "width").agg(F.sort_array(F.collect_set("start")).alias("starts"), F.size(F.collect_set("at")).alias("hits"))
    size = F.col("len") - F.col("width") + 1
    inside = lambda x, y: F.when((y - x > 1) & (y - x <= 2 * size / (1 + threshold) + 1e-6), F.sequence(x + 1, y - 1)).otherwise(F.array().cast("array<int>"))
    between = F.flatten(F.zip_with(F.slice("starts", F.lit(1), F.size("starts") - 1), F.slice("starts", F.lit(2), F.size("starts") - 1), inside))
    between = F.when(F.col("hits") + 1e-6 >= 2 * threshold * size / (1 + threshold), between).otherwise(F.array().cast("array<int>"))
    laid = lambda starts, seeded: F.transform(starts, lambda x: F.struct(x.alias("start"), F.lit(seeded).alias("seeded")))
    runs = runs.select("doc", "item", "len", "width", F.explode(F.concat(laid(F.col("starts"), 1), laid(between, 0))).alias("s"))
    runs = runs.groupBy("doc", "len", "width", "s.start").agg(F.max("s.seeded").alias("seeded"), F.collect_set("item").alias("items"))
    # all windows of a document in one row: it has no more of them than words times item sizes
    windows = runs.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("len", "width", "start", "seeded", "items")).alias("windows"))
    # texts travel, not their words: these are made again after the join, for the documents that have windows
    cut = docs.select(own, "doc_id", "text").join(windows, F.col("doc") == F.col("id")).select("doc", "doc_id", _words(F.col("text")).alias("words"), "windows")
    cut = cut.select("doc", "doc_id", "words", F.explode("windows").alias("w"))
    cut = cut.select("doc", "doc_id", "w.len", "w.width", "w.start", "w.seeded", "w.items", F.slice("words", F.col("w.start"), F.col("w.len")).alias("words"))
    cut = cut.withColumn("shingles", _numbered(_shingles(F.col("words"), F.col("width")))).withColumn("print", simhash(F.col("words"))).drop("words")
    cut = stored(cut, "windows")

    probe = cut.select("doc", "len", "start", "print", F.explode("items").alias("item"), _blocks(F.col("print"), radius).alias("b"))
    probe = probe.select("doc", "len", "start", "print", "item", F.explode("b").alias("b")).select("doc", "len", "start", "print", "item", "b.*")
    index = items.select("item_id", "item", "item_print", F.explode(_blocks(F.col("item_print"), radius)).alias("b")).select("item_id", "item", "item_print", "b.*")
    near = probe.join(index, ["item", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("doc", "len", "start", "print", "item_id", "item_print").distinct()
    near = near.select(F.col("doc").alias("id"), F.col("len").alias("len_"), F.col("start").alias("start_"), F.col("print").alias("print_"), "item_id", "item_print")
    sets = items.select("item_id", "item_print", _numbered(F.col("shingles")).alias("item_shingles"), F.col("len").alias("n_words"))
    on = (F.col("doc") == F.col("id")) & (F.col("len") == F.col("len_")) & (F.col("start") == F.col("start_")) & (F.col("print") == F.col("print_"))
    pairs = cut.join(near, on).select("doc_id", "item_id", "item_print", "start", "seeded", "shingles").join(sets, ["item_id", "item_print"])
    common = F.size(F.array_intersect("shingles", "item_shingles"))
    pairs = pairs.withColumn("similarity", common / (F.size("shingles") + F.size("item_shingles") - common)).filter(F.col("similarity") >= threshold)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "seeded", (-F.col("start")).alias("before"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.before")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"))
