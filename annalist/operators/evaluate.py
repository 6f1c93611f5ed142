"""Evaluation: metrics of predictions, rates, latencies, coverage, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_class(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall and F1 of each class that is predicted or actual; 0 where undefined."""
    counted = pairs.groupBy(F.col(predicted).alias("p"), F.col(actual).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    both = counted.select(F.explode(F.array(F.struct(F.col("p").alias("c"), F.lit("p").alias("side")), F.struct(F.col("a").alias("c"), F.lit("a").alias("side")))).alias("x"), "p", "a", "n")
    rows = both.groupBy(F.col("x.c").alias("class")).agg(
        F.sum(F.when((F.col("x.side") == "p") & (F.col("p") == F.col("a")), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("n_predicted"),
        F.sum(F.when(F.col("x.side") == "a", F.col("n")).otherwise(0)).alias("n_actual"),
    )
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    rows = rows.filter(F.col("class").isNotNull()).withColumn("precision", ratio(F.col("hits"), F.col("n_predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("n_actual")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def evaluate(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(metric, value) of a run, as :func:`regressions` compares them: macro F1, and precision, recall and F1 of each class."""
    classes = per_class(pairs, predicted, actual).select("class", "precision", "recall", "f1")
    each = classes.unpivot("class", ["precision", "recall", "f1"], "measure", "value")
    return each.select(F.concat_ws(" ", "measure", "class").alias("metric"), "value").unionByName(classes.agg(F.lit("macro f1").alias("metric"), F.avg("f1").alias("value")))


def regressions(current: DataFrame, previous: DataFrame, by: float = 0.02) -> DataFrame:
    """Metrics (metric, value) that fell by more than ``by``."""
    joined = previous.withColumnRenamed("value", "before").join(current, "metric")
    return joined.filter(F.col("before") - F.col("value") > by)


def rate_by(rows: DataFrame, by: Sequence[str], condition: Column, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(condition.cast("int")).alias(name), F.count(F.lit(1)).alias("n"))


def source_health(runs: DataFrame, source: str, ok: Column, time: str, documents: Column) -> DataFrame:
    """Last success, error rate and documents of each source."""
    return runs.groupBy(source).agg(F.max(F.when(ok, F.col(time))).alias("last_success"), F.avg((~ok).cast("int")).alias("error_rate"), F.sum(documents).alias("documents"), F.count(F.lit(1)).alias("runs"))


def compare_systems(a: DataFrame, b: DataFrame, key: str, time: str) -> DataFrame:
    """Items of two systems: in which they are (both, a, b) and who was first (a, b, tie; null if only one)."""
    joined = a.select(key, F.col(time).alias("a_at")).join(b.select(key, F.col(time).alias("b_at")), key, "full_outer")
    where = F.when(F.col("a_at").isNull(), "b").when(F.col("b_at").isNull(), "a").otherwise("both")
    first = F.when(F.col("a_at") < F.col("b_at"), "a").when(F.col("b_at") < F.col("a_at"), "b").when(F.col("a_at") == F.col("b_at"), "tie")
    return joined.withColumn("found_in", where).withColumn("first", first)


def coverage_ratio(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The share of the items of an old system that a new one has too: coverage, items, matched."""
    joined = old.select(key).distinct().join(new.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return joined.agg((F.count("__in") / F.count(F.lit(1))).alias("coverage"), F.count(F.lit(1)).alias("items"), F.count("__in").alias("matched"))


def stage_accuracy(predicted: DataFrame, gold: DataFrame, key: str, stage: str) -> DataFrame:
    """The share of projects of the gold set whose stage was predicted right; one without a prediction is wrong."""
    joined = gold.select(key, F.col(stage).alias("__gold")).join(predicted.select(key, F.col(stage).alias("__said")), key, "left")
    right = F.coalesce(F.col("__gold") == F.col("__said"), F.lit(False))
    return joined.agg(F.avg(right.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("projects"), F.count("__said").alias("predicted"))


def latency(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Seconds between two times: n, median_s, max_s; rows that lack either do not count."""
    seconds = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    return rows.select(seconds.alias("s")).agg(F.count("s").alias("n"), F.expr("percentile(s, 0.5)").alias("median_s"), F.max("s").alias("max_s"))


def version_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows added to and removed from a version, repeated ones counted."""
    a, b = before.select(*columns), after.select(*columns)
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def count_by_scale(rows: DataFrame, column: str, scale: Sequence[str]) -> DataFrame:
    """A row for each step of a fixed scale, with its place and count, empty steps too."""
    steps = rows.sparkSession.createDataFrame([(k + 1, s) for k, s in enumerate(scale)], f"place long, {column} string")
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return steps.join(counted, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
