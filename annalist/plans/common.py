"""How the stand-in tables are read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stages of a project that the kinds of events stand for.
STAGES = {"view": 1, "click": 3, "signup": 5, "purchase": 8, "error": 10}
STAGE_SQL = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 8 WHEN 'error' THEN 10 END"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the stage that their kind stands for; a user is a project."""
    return table(spark, sf_dir, "events").withColumn("stage", F.create_map(*[F.lit(x) for p in STAGES.items() for x in p])[F.col("event_type")])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a store that a query builds from the tables: in the folder that the session shares, or, where it names none, a
    local one, which only a local session may use."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
