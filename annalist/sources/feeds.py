"""Saved RSS and Atom feeds, and news searches, as rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "feed string, feed_title string, url string, title string, description string, published_at timestamp, error string"


def _text(node: ET.Element, *names: str) -> str | None:
    for child in node:
        if child.tag.rpartition("}")[2] in names:
            said = child.get("href") if child.tag.rpartition("}")[2] == "link" and child.get("href") else "".join(child.itertext())
            if said and said.strip():
                return said.strip()
    return None


def _when(text: str | None) -> pd.Timestamp | None:
    if not text:
        return None
    try:
        at = pd.Timestamp(parsedate_to_datetime(text))
    except (TypeError, ValueError):
        at = pd.to_datetime(text, errors="coerce", utc=True)
    if at is None or pd.isna(at):
        return None
    return at.tz_convert("UTC").tz_localize(None) if at.tzinfo else at


def parse_feed(name: str, content: str) -> list[dict]:
    """Items of a feed; one row with ``error`` if it is not XML, so that one source never stops the others."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return [{"feed": name, "error": str(e)}]
    channel = next((x for x in root.iter() if x.tag.rpartition("}")[2] in ("channel", "feed")), root)
    title = _text(channel, "title")
    items = [x for x in root.iter() if x.tag.rpartition("}")[2] in ("item", "entry")]
    return [
        {"feed": name, "feed_title": title, "url": _text(x, "link", "id"), "title": _text(x, "title"), "description": _text(x, "description", "summary", "content"), "published_at": _when(_text(x, "pubDate", "published", "updated"))}
        for x in items
    ]


def feed_items(saved: DataFrame) -> DataFrame:
    """Items of saved feeds (name, value: the whole XML); a feed that is not XML gives one row with ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for name, content in zip(part["name"], part["value"], strict=True) for r in parse_feed(name, content)]
            made = pd.DataFrame(rows, columns=["feed", "feed_title", "url", "title", "description", "published_at", "error"]).astype(object)
            made = made.where(made.notna(), None)
            made["published_at"] = pd.to_datetime(made["published_at"])
            yield made

    return saved.select("name", F.coalesce("value", F.lit("")).alias("value")).mapInPandas(run, ITEM)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of all feeds saved under ``path``, a file each, read through Spark's own reader."""
    return feed_items(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value"))


def stream_feed(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """The same as feeds are saved, as a stream: a file is read once, also over restarts from a checkpoint, and a broken one gives its
    row with ``error`` and stops nothing. A feed that is fetched again is saved as a new file (named by its time or ETag)."""
    saved = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path, wholetext=True)
    return feed_items(saved.select(F.col("_metadata.file_name").alias("name"), "value"))


def news_sources(items: DataFrame) -> DataFrame:
    """Items of news searches as sources: title and description are the text, and only links are kept for long."""
    items = items.filter(F.col("error").isNull() & F.col("url").isNotNull())
    return items.select("url", "title", F.concat_ws("\n", "title", "description").alias("text"), "published_at", F.lit("rss").alias("type"), F.lit("link_only").alias("retention_policy"), F.lit(False).alias("read_at_source"))


def read_news_items(spark: SparkSession, path: str) -> DataFrame:
    return news_sources(read_feed(spark, path))
