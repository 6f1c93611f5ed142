"""Entity resolution: external ids, names, trigram and vector candidates, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators import vectors as Vx
from annalist.operators.lineage import cut


#: Rows of one external id that meet in one place; an id of more is dealt out in pairs of blocks.
BLOCK_ROWS = 2_048
#: Pairs of one partition, about, and partitions, at most.
PAIRS, MOST_PARTITIONS = 4_000_000, 20_000


def match_external(mentions: DataFrame, entities: DataFrame, mention: str = "mention_id", entity: str = "entity_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(mention, entity) that have an external id of the same kind in common (column external_ids: map).

    Each pair comes once, at the first id that both have, so pairs are not shuffled. Mentions and entities of an id meet in pairs of
    blocks of some ``block_rows`` rows, so that a frequent id is no single task; the number of pairs, which goes to the driver, says how many
    partitions they are dealt to.
    """

    def side(df: DataFrame, key: str) -> DataFrame:
        """The rows of ``key`` once, by each of their ids, with all of these."""
        spread = df.select(key, F.explode("external_ids").alias("kind", "value")).filter(F.col("value").isNotNull())
        return spread.groupBy(key).agg(F.collect_set(F.struct("kind", "value")).alias("ids")).select(key, "ids", F.explode("ids").alias("id"))

    left, right = side(mentions, mention), side(entities, entity).withColumnRenamed("ids", "other_ids")
    count = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    sizes = cut(count(left, "n").join(count(right, "m"), "id"))
    partitions = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).first()[0]
    partitions = max(partitions, min(MOST_PARTITIONS, int(pairs // PAIRS) + 1))
    blocks = sizes.select("id", F.ceil(F.col("n") / block_rows).alias("n"), F.ceil(F.col("m") / block_rows).alias("m"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        placed = df.join(blocks, "id").withColumn(f"{own}_block", F.pmod(F.xxhash64(key), own)).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return placed.drop("n", "m").repartition(partitions, "id", "n_block", "m_block")

    met = dealt(left, mention, "n", "m").join(dealt(right, entity, "m", "n"), ["id", "n_block", "m_block"])
    first = (F.size("ids") == 1) | (F.size("other_ids") == 1) | (F.array_min(F.array_intersect("ids", "other_ids")) == F.col("id"))
    return met.filter(first).select(mention, entity)


def match_name(mentions: DataFrame, entities: DataFrame, name: str = "name", country: str = "country") -> DataFrame:
    """Mentions and entities with the same name key and country; both sides' other columns are kept."""
    left = mentions.withColumn("name_key", X.name_key(F.col(name))).drop(name)
    right = entities.withColumn("name_key", X.name_key(F.col(name))).drop(name)
    return left.join(right, ["name_key", country])


def trigram_links(texts: DataFrame, key: str, text: str, least: float = 0.6) -> DataFrame:
    """For every row its class (least key with the same trigrams), and the number of other classes at ``least`` or more.

    Equal trigram sets are one class. Pairs of classes meet by an equi-join on trigrams of the prefix only: sets with a Jaccard
    similarity of t have a trigram in common among the size - ceil(t * size) + 1 rarest of each.
    """
    rows = texts.select(key, F.array_sort(X.trigrams(F.col(text))).alias("grams"))
    classes = rows.groupBy("grams").agg(F.min(key).alias("class_id"))
    spread = classes.select("class_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(often, "gram").withColumn("place", F.row_number().over(W.partitionBy("class_id").orderBy("df", "gram")))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("class_id", "n", "gram")
    other = prefix.select(F.col("class_id").alias("other"), F.col("n").alias("m"), "gram")
    meet = prefix.join(other, "gram").filter((F.col("class_id") < F.col("other")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")))
    pairs = meet.select("class_id", "other").distinct()
    sets = classes.select("class_id", "grams")
    found = pairs.join(sets, "class_id").join(sets.select(F.col("class_id").alias("other"), F.col("grams").alias("grams2")), "other")
    found = found.filter(X.jaccard(F.col("grams"), F.col("grams2")) >= least)
    links = found.select("class_id").unionAll(found.select(F.col("other").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(links, "class_id", "left").select("grams", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(named, "grams").select(key, "class_id", "n_links")


def candidates(mentions: DataFrame, entities: DataFrame, k: int = 10, least: float = 0.3, mention: str = "mention_id", entity: str = "entity_id", name: str = "name") -> DataFrame:
    """(mention, entity, confidence, rank): the ``k`` entities whose names are most alike by trigrams, at ``least`` or more; ties
    take the least entity. It can be a step of :func:`decide`.

    Mentions and entities meet by an equi-join on the rarest trigrams only, as in :func:`trigram_links`; counts are of entities.
    """
    side = lambda df, key: df.select(F.col(key), F.array_sort(X.trigrams(F.col(name))).alias("grams"))
    left, right = side(mentions, mention).distinct(), side(entities, entity).distinct()
    often = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        spread = df.select(key, "grams", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(often, "gram", "left")
        placed = spread.withColumn("place", F.row_number().over(W.partitionBy(key, "grams").orderBy(F.coalesce("df", F.lit(0)), "gram")))
        return placed.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select(F.col(key), "n", "gram")

    other = prefix(right, entity).withColumnRenamed("n", "m")
    meet = prefix(left, mention).join(other, "gram").filter(F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")).select(mention, entity).distinct()
    found = meet.join(left, mention).join(right.withColumnRenamed("grams", "grams2"), entity)
    best = found.groupBy(mention, entity).agg(F.max(X.jaccard(F.col("grams"), F.col("grams2"))).alias("confidence")).filter(F.col("confidence") >= least)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy(mention).orderBy(F.col("confidence").desc(), entity)).cast("long"))
    return ranked.filter(F.col("rank") <= k).select(mention, entity, "confidence", "rank")


def active_merges(merges: DataFrame, splits: DataFrame) -> DataFrame:
    """Merges (entity_id, merged_into, at) that no later split (entity_id, split_from, at) of the two undid."""
    later = splits.groupBy(F.col("entity_id").alias("__e"), F.col("split_from").alias("__m")).agg(F.max("at").alias("__at"))
    return merges.join(later, (F.col("entity_id") == F.col("__e")) & (F.col("merged_into") == F.col("__m")) & (F.col("__at") > F.col("at")), "left_anti")


def vector_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, blocks: int | None = None) -> DataFrame:
    """The ``k`` most similar vectors (cosine) of all for each query, itself left out: (query, key, similarity, rank).

    A stated set of queries against all rows: queries go to every block of vectors in parts, both of ``Vx.CELL_ROWS`` rows or so at most, each
    block and part is a matrix product (:func:`annalist.operators.vectors.block_best`), and the best k of each block are ranked.
    There are two blocks (``blocks``) for each core at least. Vectors without a direction have no similarity, and come last.
    """
    blocks = blocks or max(16, 2 * queries.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // Vx.CELL_ROWS))
    parts = Vx.query_parts(queries, Vx.CELL_ROWS)
    sides = lambda name: (F.col(vector).cast("array<double>").alias(name), F.sqrt(X.dot(F.col(vector), F.col(vector))).alias(f"{name}_length"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = Vx.usable(queries, vector).select(F.col(key).alias("query"), *sides("q"), part(key, parts).alias("part")).withColumn("block", every(blocks))
    right = Vx.usable(vectors, vector).select(key, *sides("v"), part(key, blocks).alias("block")).withColumn("part", every(parts))
    scored = Vx.block_best(left, right, key, k, ["block", "part"])
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("similarity").desc(), key))).filter(F.col("rank") <= k)
    return ranked(scored.unionByName(_without_direction(queries, vectors, key, vector, k)))


def _without_direction(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Of queries and vectors of which one has no direction, the ``k`` least keys for each query, with a null similarity.

    They are alike for all queries but for a query's own row, so ``k + 1`` rows are looked at for each.
    """
    odd = lambda df: df.join(Vx.usable(df, vector).select(key).distinct(), key, "left_anti")
    least = lambda df: F.broadcast(df.select(key).orderBy(key).limit(k + 1))
    names = lambda df: df.select(F.col(key).alias("query"))
    pairs = names(Vx.usable(queries, vector)).crossJoin(least(odd(vectors))).unionAll(names(odd(queries)).crossJoin(least(vectors)))
    return pairs.filter(F.col("query") != F.col(key)).withColumn("similarity", F.lit(None).cast("double"))


def canonical_ids(merges: DataFrame, rounds: int = 64) -> DataFrame:
    """(entity_id, canonical_id) for chains of merges (entity_id into merged_into), by pointer doubling.

    Of several merges of an entity the smallest target counts. An entity's id is the end of its chain; where the chain runs into
    a cycle, it is the least id of that cycle. Each round doubles the steps and the least id seen on them. While a chain is longer
    than the steps, some entities reach its end in every round; once none does, all that are left lead into cycles, and the
    steps that outnumber them have been all around. So 64 rounds are more than any table needs.
    """
    first = merges.filter(F.col("entity_id").isNotNull() & F.col("merged_into").isNotNull()).groupBy("entity_id").agg(F.min("merged_into").alias("goal"))
    links = cut(first.select("entity_id", "goal", F.col("entity_id").alias("least"), F.lit(False).alias("ended")))
    before = None
    for k in range(rounds):
        hop = links.select(F.col("entity_id").alias("goal"), F.col("goal").alias("next"), F.col("least").alias("next_least"), F.col("ended").alias("next_ended"), F.lit(True).alias("met"))
        open_ = links.filter("NOT ended").join(hop, "goal", "left")
        moved = open_.select("entity_id", F.coalesce("next", "goal").alias("goal"), F.least("least", "next_least").alias("least"), (F.col("met").isNull() | F.col("next_ended")).alias("ended"))
        links = cut(links.filter("ended").unionByName(moved))
        left = links.filter("NOT ended").count()
        if not left or (left == before and left <= 2 ** (k + 1)):
            break
        before = left
    circle = links.filter("NOT ended").select(F.col("entity_id").alias("goal"), F.col("least").alias("of_cycle"))
    found = links.join(circle, "goal", "left")
    return found.select("entity_id", F.when(F.col("ended"), F.col("goal")).otherwise(F.col("of_cycle")).alias("canonical_id"))


def identity_at(merges: DataFrame, splits: DataFrame, at: Column) -> DataFrame:
    """(entity_id, canonical_id) as of a time: of the merges up to it those that no split up to it undid, followed to their ends.

    ``merges``: entity_id, merged_into, at; ``splits``: entity_id, split_from, at. A merge after a split holds again.
    """
    known = lambda df: df.filter(F.col("at") <= at)
    return canonical_ids(active_merges(known(merges), known(splits)))


def decide(mentions: DataFrame, *steps: DataFrame, mention: str = "mention_id", entity: str = "entity_id", certain: float = 0.9) -> DataFrame:
    """Take the first step that knows a mention: each step has (mention, entity, confidence); one with several entities decides
    nothing. Returns mention, entity, confidence, decision: match, review or new."""
    out = mentions.select(mention).distinct()
    found: Column = F.lit(None)
    for k, step in enumerate(steps):
        one = step.groupBy(mention).agg(F.count_distinct(entity).alias("n"), F.max(F.struct("confidence", entity)).alias("x"))
        out = out.join(one.select(mention, F.struct(F.col(f"x.{entity}").alias(entity), F.col("x.confidence").alias("confidence"), F.col("n")).alias(f"s{k}")), mention, "left")
    found = F.coalesce(*[F.col(f"s{k}") for k in range(len(steps))])
    out = out.select(mention, found.alias("x")).select(mention, f"x.{entity}", "x.confidence", "x.n")
    decision = F.when(F.col(entity).isNull(), "new").when((F.col("n") > 1) | (F.col("confidence") < certain), "review").otherwise("match")
    return out.withColumn("decision", decision).drop("n")
