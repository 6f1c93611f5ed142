"""From raw documents to token ids: quality, exact dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next one's
docs. The first four return the columns of documents, fewer rows; the last adds the ids. A stage needs the columns doc_id and
text and passes all others on.

Rows that share a doc_id, and rows without one, are told apart by their texts in every stage; of rows that are equal in both, exact
and near dedup keep any one. Every stage takes an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontam, exact_dedup, pieces, quality, setsketch
from annalist.llm.queries import PIECE_MODEL, QUALITY_CUT
from annalist.llm.shared import ascii_lower, fresh, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: a score of QUALITY_CUT or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    to = fresh(docs, "__quality")
    return quality.score(docs, model, to=to).filter(F.col(to) >= QUALITY_CUT).select(*docs.columns)


def _one_each(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names (id, digest, n), one for each name. Only names of several rows (n > 1) have theirs
    shuffled whole."""
    named = docs.withColumn("__digest", digest)
    same = lambda names: named["doc_id"].eqNullSafe(names["__id"]) & (named["__digest"] == names["__sha"])
    alone, several = kept.filter("n = 1"), kept.filter("n > 1")
    rows = named.join(alone, same(alone), "left_semi")
    if several.limit(1).count():
        rows = rows.unionByName(named.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "__digest"]))
    return rows.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for the case of A-Z, the one with the largest doc_id; of several with that id, or of
    several without any, one."""
    found = exact_dedup.exact_duplicates(docs).filter("kept")
    kept = stored(found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("n")), "kept")
    return _one_each(docs, F.sha2(ascii_lower(docs["text"]), 256), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are linked by a similarity of 0.8 or more: the smallest doc_id, and of rows
    with that id, or of a group without ids, the one whose text has the smallest hash. Texts without words all stay."""
    found = setsketch.near_components(docs, percent=80, text_key=True)
    rows = found.groupBy("family", F.col("doc_id").alias("__id"), F.col("text_key").alias("__sha")).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "rows")
    least = rows.filter("family IS NOT NULL").groupBy("family").agg(F.min(F.struct(F.col("__id").isNull().alias("nameless"), "__id", "__sha", "n")).alias("first")).select("first.__id", "first.__sha", "first.n")
    wordless = rows.filter("family IS NULL").select("__id", "__sha", F.lit(1).cast("long").alias("n"))
    return _one_each(docs, F.xxhash64(docs["text"]), stored(least.unionByName(wordless), "kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark (similarity 0.8 or more); of rows that share a doc_id, those whose text holds none."""
    key = F.xxhash64(docs["doc_id"], docs["text"])
    found = decontam.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, key == F.col("__id"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding these gives the text again."""
    return pieces.encode(docs, PIECE_MODEL, verify="round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: Learning, sketches and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
