"""Intervals, forecasts, schedules and lead times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.model import ENGAGEMENT_WINDOW


def in_window(stage: Column) -> Column:
    return stage.between(*ENGAGEMENT_WINDOW)


def stage_intervals(events: DataFrame, project: str, order: Sequence[str], stage: str, time: str) -> DataFrame:
    """(project, from_stage, to_stage, started, days) for each two stages that follow one another in a project."""
    w = W.partitionBy(project).orderBy(*order)
    rows = events.select(project, F.col(stage).alias("from_stage"), F.lead(stage).over(w).alias("to_stage"), F.col(time).alias("started"), F.lead(time).over(w).alias("ended"))
    return rows.filter(F.col("to_stage").isNotNull()).select(project, "from_stage", "to_stage", "started", F.datediff("ended", "started").alias("days"))


def interval_stats(intervals: DataFrame, project: str, least: int = 5) -> DataFrame:
    """Median and range of each pair of stages, and how many projects support it. Fewer than ``least``: supported is false."""
    stats = intervals.groupBy("from_stage", "to_stage").agg(
        F.expr("percentile(days, 0.5)").alias("median_days"),
        F.min("days").cast("long").alias("min_days"),
        F.max("days").cast("long").alias("max_days"),
        F.count_distinct(project).alias("projects"),
    )
    return stats.withColumn("supported", F.col("projects") >= least)


def forecast(current: DataFrame, stats: DataFrame, stage: str, time: str) -> DataFrame:
    """Dates at which a project in ``stage`` since ``time`` moves on; no date where an interval lacks support.

    ``stats`` has a row for each pair of stages, a fixed small number, and is broadcast.
    """
    usable = F.broadcast(stats.filter("supported"))
    joined = current.join(usable, F.col(stage) == F.col("from_stage"), "left")
    day = lambda n: F.date_add(F.col(time).cast("date"), F.round(n).cast("int"))
    return joined.withColumn("earliest", day(F.col("min_days"))).withColumn("middle", day(F.floor(F.col("median_days")))).withColumn("latest", day(F.col("max_days")))


def calendar(forecasts: DataFrame, now: Column, months: int = 24, date: str = "earliest") -> DataFrame:
    return forecasts.filter((F.col(date) >= now) & (F.col(date) < F.add_months(now, months)))


def window_entry(events: DataFrame, project: str, order: Sequence[str], stage: str) -> DataFrame:
    """Events by which a project enters the engagement window (also as its first event)."""
    before = F.lag(stage).over(W.partitionBy(project).orderBy(*order))
    return events.withColumn("before", before).filter(in_window(F.col(stage)) & ~F.coalesce(in_window(F.col("before")), F.lit(False)))


def forecast_shift(forecasts: DataFrame, key: str, order: Sequence[str], date: str, months: int = 6) -> DataFrame:
    """Forecasts whose date is ``months`` or more nearer than that of the forecast before.

    Months are added by the calendar: a day that the month reached lacks is that month's last (30 August and six months are 28 February).
    """
    before = F.lag(date).over(W.partitionBy(key).orderBy(*order))
    rows = forecasts.withColumn("before", before)
    return rows.filter(F.col("before") >= F.col(date) + F.make_ym_interval(F.lit(0), F.lit(months)))


def first_signal(procurements: DataFrame, signals: DataFrame, project: str, time: str) -> DataFrame:
    """For each procurement (project, id, time) the first signal (project, time) of its project before it.

    The first signal of a project is one value, so the range join is a grouping and an equi-join.
    """
    first = signals.groupBy(project).agg(F.min(time).alias("signal_at"))
    joined = procurements.join(first, project, "left")
    return joined.withColumn("signal_at", F.when(F.col("signal_at") < F.col(time), F.col("signal_at")))


def backtest(found: DataFrame, time: str) -> DataFrame:
    """Hit rate and median lead in months of :func:`first_signal`."""
    lead = F.floor(F.months_between(time, "signal_at"))
    return found.agg(
        F.count(F.lit(1)).alias("procurements"),
        F.count("signal_at").alias("hits"),
        (F.count("signal_at") / F.count(F.lit(1))).alias("hit_rate"),
        F.expr(f"percentile(floor(months_between({time}, signal_at)), 0.5)").alias("median_months"),
        F.min(lead).alias("least_months"),
    )


def local_time(time: Column, zone: str = "Africa/Lusaka") -> Column:
    """A UTC wall-clock time as one of ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), time)


def due(time: Column, cadence: Column) -> Column:
    """Whether a run is due on the day of a local time: every day for daily, on Monday for weekly."""
    return F.when(cadence == "daily", F.lit(True)).when(cadence == "weekly", F.dayofweek(time) == 2).otherwise(F.lit(False))


def _field(value: Column, field: Column, first: int) -> Column:
    """Whether a number fits one field of a cron expression: lists of *, n, a-b, each with /step."""

    def fits(item: Column) -> Column:
        step = F.coalesce(F.split_part(item, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(1))
        span = F.split_part(item, F.lit("/"), F.lit(1))
        low = F.when(span == "*", F.lit(first)).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        high = F.when((span == "*") | (F.contains(item, F.lit("/")) & ~F.contains(span, F.lit("-"))), F.lit(99)).otherwise(F.coalesce(F.split_part(span, F.lit("-"), F.lit(2)).try_cast("int"), low))
        return (value >= low) & (value <= high) & ((value - low) % step == 0)

    return F.exists(F.split(field, ","), fits)


def cron_due(time: Column, cron: Column) -> Column:
    """Whether a cron expression (minute, hour, day, month, day of the week: 0 and 7 are Sunday) is due in the minute of a local
    time. Days of the month and of the week both have to fit. An expression without five fields is never due."""
    fields = F.split(F.trim(cron), r"\s+")
    day = F.dayofweek(time) - 1
    weekday = _field(day, fields[4], 0) | ((day == 0) & _field(F.lit(7), fields[4], 0))
    ok = _field(F.minute(time), fields[0], 0) & _field(F.hour(time), fields[1], 0) & _field(F.dayofmonth(time), fields[2], 1) & _field(F.month(time), fields[3], 1) & weekday
    return F.coalesce(F.when(F.size(fields) == 5, ok), F.lit(False))


def jitter_seconds(key: Column) -> Column:
    """0 to 59 seconds, the same for a key each time."""
    return F.pmod(F.xxhash64(key), F.lit(60)).cast("int")


def next_try(at: Column, attempts: Column, seconds: int = 60, most: int = 3) -> Column:
    """When to try again after ``attempts`` failures: exponential backoff, null after ``most``."""
    return F.when(attempts <= most, F.timestamp_add("SECOND", (F.lit(seconds) * F.pow(F.lit(2.0), attempts - 1)).cast("int"), at))


def slots(requests: DataFrame, domain: str, order: Sequence[str], seconds: int = 5) -> DataFrame:
    """Seconds from the start of a run at which each request may go: ``seconds`` apart within a domain."""
    place = F.row_number().over(W.partitionBy(domain).orderBy(*order)) - 1
    return requests.withColumn("wait_s", (place * seconds).cast("long"))
