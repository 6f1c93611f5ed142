"""Pages of documents whose text was extracted before (PDF, OCR), saved web pages and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.sources.web import main_text

PAGE = "source_id string, page int, text string, ocr_text string"


def read_pages(spark: SparkSession, path: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Main texts of saved web pages (Parquet)."""
    return main_text(spark.read.parquet(path), key, html)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Documents of page texts saved as JSON lines (source_id, page, text, ocr_text): :func:`merge_pages`."""
    return merge_pages(spark.read.schema(PAGE).json(path))


def merge_pages(pages: DataFrame) -> DataFrame:
    """One row for each document of page texts (source_id, page, text, ocr_text): text, page_map, ocr.

    There is no PDF library here: pages come with their text layer, or with that of an OCR engine where they have none. A
    document's pages are one value of the output.
    """
    own = F.coalesce(F.nullif("text", F.lit("")), F.col("ocr_text"), F.lit(""))
    rows = pages.select("source_id", "page", X.normalise(own).alias("text"), (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("ocr"))
    merged = rows.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"), F.bool_or("ocr").alias("ocr"))
    starts = F.aggregate("p", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x["text"])))
    return merged.select("source_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.slice(starts, 1, F.size("p")).alias("page_map"), "ocr")


def load_fixtures(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a folder by name, also as temporary views."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def gold_coverage(gold: DataFrame, code: str = "code") -> DataFrame:
    """Documents of the gold set, and how many have each code that a threshold is set for."""
    return gold.agg(F.count_distinct("doc_id").alias("documents"), F.count_if(F.col(code) == "demand_driver").alias("drivers"), F.count_if(F.col(code) == "procurement").alias("procurements"))
