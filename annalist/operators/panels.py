"""Read models: feeds, boards, timelines, watch lists.

``at``: read as it was known then; rows are cut by their column ``time`` before anything is folded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.evaluate import count_by_scale
from annalist.operators.events import as_of, latest_of, state_at


def _then(rows: DataFrame, at: Column | None, time: str) -> DataFrame:
    return rows if at is None else as_of(rows, at, time)


def feed(signals: DataFrame, at: Column | None = None, time: str = "recorded_at", **wanted: Sequence) -> DataFrame:
    """Signals whose columns are among the wanted values; filters that are empty hold back nothing."""
    signals = _then(signals, at, time)
    for column, values in wanted.items():
        if values:
            signals = signals.filter(F.col(column).isin(*values))
    return signals


def collect_all(*outputs: DataFrame) -> DataFrame:
    """The outputs of collectors as one frame; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs)


def ticker(signals: DataFrame, order: Sequence[Column], n: int, at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """The first ``n`` signals: a top-n in each task, then of those."""
    return _then(signals, at, time).orderBy(*order).limit(n)


def kanban(events: DataFrame, key: str, order: Sequence[str], stage: str, stages: Sequence[str], at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """How many deals are in each stage by their last event, empty stages too."""
    return count_by_scale(state_at(events, at, [key], order, [stage], time), stage, stages)


def kanban_cards(events: DataFrame, key: str, order: Sequence[str], stage: str, stages: Sequence[str], card: Sequence[str], at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """The cards of each column of the board: place (of the stage), stage, the key and ``card`` of each deal that is in it by its last
    event, and ``rank``, the latest first (ties: the lesser key). A stage without deals has one row of nulls, so that its column is
    there. A row a card, not a list: a stage may hold any number.
    """
    last = state_at(events, at, [key], order, [stage, *card, *order], time)
    board = events.sparkSession.createDataFrame([(k, s) for k, s in enumerate(stages)], f"place int, {stage} string")
    newest = [F.col(c).desc() for c in order]
    ranked = last.withColumn("rank", F.row_number().over(W.partitionBy(stage).orderBy(*newest, key)).cast("long"))
    return board.join(ranked, stage, "left").select("place", stage, "rank", key, *card)


def timeline(*kinds: DataFrame, key: str, order: Sequence[str], at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """Events of several kinds as one, with their ``place`` within each key; columns that one kind lacks are null."""
    rows = _then(collect_all(*kinds), at, time)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


def with_evidence(events: DataFrame, evidence: DataFrame, ids: str, key: str, at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """A row for each event and piece of evidence that it names."""
    return _then(events, at, time).withColumn(key, F.explode(ids)).drop(ids).join(evidence, key)


def no_contact(opportunities: DataFrame, contacts: DataFrame, key: str, at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    return opportunities.join(_then(contacts, at, time).select(key).distinct(), key, "left_anti")


def watch_list(entities: DataFrame, reports: DataFrame, key: str, order: Sequence[str], at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """Entities with their latest report, also those without one."""
    return entities.join(latest_of(_then(reports, at, time), [key], order), key, "left")


def buyers(projects: DataFrame, roles: DataFrame, key: str, role: str, name: str, known: Sequence[str], at: Column | None = None, time: str = "recorded_at") -> DataFrame:
    """A column for each known role with the (least) name that has it."""
    wide = _then(roles, at, time).groupBy(key).pivot(role, list(known)).agg(F.min(name))
    return projects.join(wide, key, "left")


def relationship(opportunities: DataFrame, key: str, at: Column | None = None, time: str = "recorded_at", **parts: DataFrame) -> DataFrame:
    """Each opportunity with its contacts, touchpoints, ... as sorted arrays; empty where there are none."""
    for name, rows in parts.items():
        rows = _then(rows, at, time)
        rest = [c for c in rows.columns if c != key]
        grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        opportunities = opportunities.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return opportunities
