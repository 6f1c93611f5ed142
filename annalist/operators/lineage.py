"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept by checkpoint in the folder of ``spark.checkpoint.dir``. A local session that names none gets
    a local folder; on a cluster it must be named, as executors share no other."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{tempfile.gettempdir()}/annalist-rounds"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
