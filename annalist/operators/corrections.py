"""Corrections, retractions, rejections and moves by hand: what people may do to a log that nobody can change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist import model
from annalist.operators import events as E


def supersede(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human events that take the place of the events ``corrections`` names.

    ``corrections``: event_id, new_id, payload, evidence_ids, certainty, actor_id, recorded_at. Stream and type are those of the
    corrected event. Unknown events have no correction.
    """
    old = events.select(F.col("id").alias("event_id"), "stream_type", "stream_id", "event_type")
    return corrections.join(old, "event_id").select(
        F.col("new_id").alias("id"),
        "stream_type",
        "stream_id",
        "event_type",
        "payload",
        "evidence_ids",
        "certainty",
        F.lit("human").alias("actor_type"),
        "actor_id",
        F.col("event_id").alias("supersedes_event_id"),
        "recorded_at",
    )


def retract(events: DataFrame, retractions: DataFrame) -> DataFrame:
    """ClaimRetracted events, which hide what they retract; ``retractions``: event_id, new_id, reason, actor_id, recorded_at.

    One without a reason is made too: the store refuses it and keeps it in quarantine.
    """
    old = events.select(F.col("id").alias("event_id"), "stream_type", "stream_id")
    return retractions.join(old, "event_id").select(
        F.col("new_id").alias("id"),
        "stream_type",
        "stream_id",
        F.lit("ClaimRetracted").alias("event_type"),
        F.to_json(F.struct("event_id", F.coalesce(F.trim("reason"), F.lit("")).alias("reason"))).alias("payload"),
        F.array().cast("array<string>").alias("evidence_ids"),
        F.lit("human").alias("actor_type"),
        "actor_id",
        F.col("event_id").alias("supersedes_event_id"),
        "recorded_at",
    )


def reject(proposals: DataFrame, rejections: DataFrame) -> DataFrame:
    """Decisions (proposal_id, status, reason, actor_id, recorded_at) on proposals; no event comes of them.

    ``rejections``: proposal_id, reason, actor_id, recorded_at. A rejection needs a reason and a proposal; others are left out.
    """
    known = proposals.select(F.col("id").alias("proposal_id"))
    reasoned = rejections.filter(F.length(F.trim("reason")) > 0)
    return reasoned.join(known, "proposal_id", "left_semi").select("proposal_id", F.lit("rejected").alias("status"), "reason", "actor_id", "recorded_at")


def propose_stage(moves: DataFrame, stages: Sequence[str] = model.DEAL_STAGES) -> DataFrame:
    """Pending proposals of moves by hand (id, deal_id, stage, reason, actor_id, moved_at); unknown stages are left out.

    A move is never an event at once: it waits for someone else's approval.
    """
    return moves.filter(F.col("stage").isin(*stages)).select(
        "id",
        F.lit("DealStageChanged").alias("event_type"),
        F.to_json(F.struct("deal_id", "stage", "reason")).alias("payload"),
        F.array().cast("array<string>").alias("evidence_ids"),
        F.lit(None).cast("string").alias("certainty"),
        F.lit(None).cast("double").alias("confidence"),
        F.col("actor_id").alias("created_by"),
        F.col("moved_at").alias("created_at"),
    )


def rebuild(events: DataFrame, projections: Mapping[str, tuple[Sequence[str], Sequence[str]]], order: Sequence[str] = ("recorded_at", "sequence", "id")) -> dict[str, DataFrame]:
    """Every projection (name: keys and values) from the log alone. Equal logs give equal ``frame_hash`` values."""
    current = E.current_events(events)
    return {name: E.project_state(current, list(keys), list(order), list(values)) for name, (keys, values) in projections.items()}


def run_counts(found: DataFrame, stored: DataFrame, source: str = "source_key", key: str = "content_hash") -> DataFrame:
    """For each source of a run: documents found, and how many of them the store did not have."""
    have = stored.select(key).distinct().withColumn("__have", F.lit(True))
    return found.join(have, key, "left").groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("__have").isNull()).alias("added"))
