"""Briefs and configuration from YAML, as small frames."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRIEF = (
    "id string, activated_at timestamp, sources array<struct<type:string,url:string,cron:string,licence_code:string>>, "
    "early_signal array<struct<type:string,url:string,cron:string,licence_code:string>>, keywords array<string>, exclusions array<string>, "
    "weights map<string,double>, watched array<struct<entity_id:string,watch:string>>, gaps array<string>"
)


def load_config(spark: SparkSession, path: str) -> Mapping:
    """A YAML file of any store that Spark reads; it is configuration, and small."""
    return yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) or {}


def load_brief(spark: SparkSession, path: str) -> DataFrame:
    """Versions of a brief (a mapping or a list of them); a version never changes once it is written."""
    found = load_config(spark, path)
    rows = [json.dumps(v, default=str) for v in (found if isinstance(found, list) else [found])]
    return spark.createDataFrame([(r,) for r in rows], "json string").select(F.from_json("json", BRIEF).alias("b")).select("b.*")


def active_brief(briefs: DataFrame, at) -> DataFrame:
    """The version that is active at a time: one row, resolved once a run."""
    return briefs.filter(F.col("activated_at") <= at).orderBy(F.col("activated_at").desc(), F.col("id").desc()).limit(1)


def stamp_brief(rows: DataFrame, brief: DataFrame) -> DataFrame:
    """Rows with the id of the active version (``brief``: one row)."""
    head = brief.select("id").first()
    return rows.withColumn("brief_version_id", F.lit(head[0] if head else None).cast("string"))


def brief_sources(briefs: DataFrame) -> DataFrame:
    """The sources of each version, those of early signals among them (``early``)."""
    marked = lambda c, early: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(early).alias("early")))
    both = F.flatten(F.array_compact(F.array(*[marked(c, early) for c, early in (("sources", False), ("early_signal", True)) if c in briefs.columns])))
    return briefs.select(F.col("id").alias("brief_version_id"), F.explode(both).alias("x")).select("brief_version_id", "x.s.*", "x.early")


def known_gaps(briefs: DataFrame) -> DataFrame:
    return briefs.select(F.col("id").alias("brief_version_id"), F.explode("gaps").alias("gap"))


def uncovered(types: DataFrame, sources: DataFrame, gaps: DataFrame, key: str = "type") -> DataFrame:
    """Source types that are neither collected nor listed as a gap."""
    return types.join(sources.select(key).distinct(), key, "left_anti").join(gaps.select(F.col("gap").alias(key)).distinct(), key, "left_anti")


def unresolved(values: DataFrame, excused: DataFrame, placeholders: Sequence[str]) -> DataFrame:
    """Values (path, value) of a brief that are placeholders still and whose path is not among the excused ones."""
    return values.filter(F.col("value").isin(*placeholders)).join(excused.select("path").distinct(), "path", "left_anti")


def accept_source(briefs: DataFrame, base: str, new_id: str, at: str, source: tuple[str, str, str, str]) -> DataFrame:
    """A new version of the brief ``base`` with one source (type, url, cron, licence) more; the old one stays as it is."""
    entry = F.struct(*[F.lit(x).alias(n) for x, n in zip(source, ("type", "url", "cron", "licence_code"), strict=True)])
    version = briefs.filter(F.col("id") == base).withColumns({"id": F.lit(new_id), "activated_at": F.lit(at).cast("timestamp"), "sources": F.concat(F.coalesce("sources", F.array().cast(briefs.schema["sources"].dataType)), F.array(entry))})
    return version
