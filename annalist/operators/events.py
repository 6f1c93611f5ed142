"""The event log: sequence, hash chain, point-in-time reads, supersession, folds and projections.

Streams are independent: every function shuffles by stream at most once, and state is a function of events.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.model import ACTOR_TYPES, EVENT_TYPES, HUMAN_ONLY, STREAM_TYPES

STREAM = ("stream_type", "stream_id")


def as_of(events: DataFrame, at: Column, time: str = "recorded_at") -> DataFrame:
    """What was recorded up to ``at``. Cut first, then supersede and fold: the other order hides facts that were current then."""
    return events.filter(F.col(time) <= at)


def current_events(events: DataFrame, id_column: str = "id", supersedes: str = "supersedes_event_id") -> DataFrame:
    """Events that no event of the same frame names as superseded."""
    gone = events.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("__gone")).distinct()
    return events.join(gone, F.col(id_column) == F.col("__gone"), "left_anti")


def project_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Last write wins: ``values`` of the last event of each key, by ``order``."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    return events.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])


def assign_sequence(events: DataFrame, stream: Sequence[str] = STREAM, order: Sequence[str] = ("recorded_at", "id"), heads: DataFrame | None = None) -> DataFrame:
    """Number the events of each stream from 1, or from one more than ``heads`` (the stream's columns and ``head``) says."""
    place = F.row_number().over(W.partitionBy(*stream).orderBy(*order)).cast("long")
    if heads is None:
        return events.withColumn("sequence", place)
    joined = events.withColumn("sequence", place).join(heads, list(stream), "left")
    return joined.withColumn("sequence", F.col("sequence") + F.coalesce("head", F.lit(0))).drop("head")


def canonical(*columns: str | Column) -> Column:
    """The canonical content of an event for hashing: its columns as text, JSON-quoted, null as null, joined by |."""
    escaped = lambda c: F.replace(F.replace((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    quoted = [F.coalesce(F.concat(F.lit('"'), escaped(c), F.lit('"')), F.lit("null")) for c in columns]
    return F.concat_ws("|", *quoted)


def hash_chain(events: DataFrame, content: Column, stream: Sequence[str] = STREAM, order: Sequence[str] = ("sequence",), seeds: DataFrame | None = None) -> DataFrame:
    """Add prev_hash and hash: SHA-256 of the previous hash (empty, or ``seeds``: stream and ``hash``, at first) and the content.

    A chain is sequential within its stream. Streams are dealt to tasks and sorted there, and a task holds one hash at a time, so
    a stream of any length needs no memory.
    """
    rows = events.withColumn("__content", F.concat(F.lit("|"), content))
    rows = rows.join(seeds.select(*stream, F.col("hash").alias("__seed")), list(stream), "left") if seeds is not None else rows.withColumn("__seed", F.lit(None).cast("string"))
    rows = rows.repartition(*stream).sortWithinPartitions(*stream, *order)
    return _linked(rows, stream, [c for c in events.columns if c not in ("prev_hash", "hash")])


def extend_chain(events: DataFrame, content: Column, heads: DataFrame | None = None, stream: Sequence[str] = STREAM, order: Sequence[str] = ("recorded_at", "id")) -> DataFrame:
    """:func:`assign_sequence` and :func:`hash_chain` in one shuffle; ``heads``: the stream's columns, ``head`` and ``hash``.

    Heads are shuffled with the events, as first rows of their streams, so nothing is joined; one without events gives no row.
    """
    rows = events.withColumns({"__head": F.lit(None).cast("long"), "__end": F.lit(None).cast("string")})
    if heads is not None:
        rows = rows.unionByName(heads.select(*stream, F.col("head").alias("__head"), F.col("hash").alias("__end")), allowMissingColumns=True)
    w = W.partitionBy(*stream).orderBy(F.col("__head").desc_nulls_last(), *order)
    before = F.first("__head").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    sequence = F.row_number().over(w).cast("long") + F.coalesce(before - 1, F.lit(0))
    rows = rows.repartition(*stream).withColumns({"sequence": sequence, "__seed": F.lag("__end").over(w)})  # the window sorts each task's streams
    rows = rows.filter(F.col("__head").isNull()).withColumn("__content", F.concat(F.lit("|"), content)).drop("__head", "__end")
    return _linked(rows, stream, [*[c for c in events.columns if c != "sequence"], "sequence"])


def _linked(rows: DataFrame, stream: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Rows whose streams are whole and in order in their tasks, with prev_hash and hash; the first of a stream has its ``__seed``."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", prev_hash string, hash string"
    rows = rows.select(*kept, "__content", "__seed")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, ""
        for part in parts:
            before, after = [], []
            keys = zip(*(part.column(c).to_pylist() for c in stream), strict=True)
            for key, text, seed in zip(keys, part.column("__content").to_pylist(), part.column("__seed").to_pylist(), strict=True):
                if key != at:
                    at, last = key, seed or ""
                before.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*kept, "prev_hash", "hash"])

    return rows.mapInArrow(run, schema)


def chain_breaks(events: DataFrame, content: Column, stream: Sequence[str] = STREAM, order: Sequence[str] = ("sequence",)) -> DataFrame:
    """Events whose prev_hash is not the hash before them (link_ok), whose hash is not that of their content (hash_ok), or whose
    sequence does not follow the one before (sequence_ok).

    A null in any of these is a break. An end that was cut off leaves no break: see :func:`cut_ends`.
    """
    w = W.partitionBy(*stream).orderBy(*order)
    holds = lambda c: F.coalesce(c, F.lit(False))
    checked = events.withColumns(
        {
            "link_ok": holds(F.col("prev_hash") == F.lag("hash", 1, "").over(w)),
            "hash_ok": holds(F.col("hash") == F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), content), 256)),
            "sequence_ok": holds(F.col("sequence") == F.lag("sequence", 1, 0).over(w) + 1),
        }
    )
    return checked.filter(~(F.col("link_ok") & F.col("hash_ok") & F.col("sequence_ok")))


def cut_ends(events: DataFrame, heads: DataFrame, stream: Sequence[str] = STREAM) -> DataFrame:
    """Streams whose last event is not the one that ``heads`` (the stream's columns, head, hash) names: their head, and ``last``,
    the sequence of the last event that is left (null: none)."""
    ends = events.groupBy(*stream).agg(F.max("sequence").alias("last"), F.max_by("hash", "sequence").alias("__hash"))
    on = [heads[c].eqNullSafe(ends[c]) for c in stream]
    joined = heads.join(ends, on, "left").select(*[heads[c] for c in stream], "head", "last", heads["hash"], "__hash")
    return joined.filter(~(F.col("head").eqNullSafe(F.col("last")) & F.col("hash").eqNullSafe(F.col("__hash")))).drop("hash", "__hash")


def spans(events: DataFrame, stream: Sequence[str], order: Sequence[str], time: str) -> DataFrame:
    """valid_from and valid_to (null: still valid) of what each event says."""
    nxt = F.lead(time).over(W.partitionBy(*stream).orderBy(*order))
    return events.withColumn("valid_from", F.col(time)).withColumn("valid_to", nxt)


def changes(events: DataFrame, stream: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Events whose value differs from the one before in their stream (``before``); first events are not changes."""
    return events.withColumn("before", F.lag(value).over(W.partitionBy(*stream).orderBy(*order))).filter(F.col("before") != F.col(value))


def first_of(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return events.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def latest_of(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ordering = [F.col(c).desc() for c in order]
    return events.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*ordering))).filter("__k = 1").drop("__k")


def state_at(events: DataFrame, at: Column | None, keys: Sequence[str], order: Sequence[str], values: Sequence[str], time: str = "recorded_at", id_column: str | None = None, supersedes: str = "supersedes_event_id") -> DataFrame:
    """The state at a time (None: now): cut, then hide what was superseded by then (``id_column``: with it), then fold."""
    known = events if at is None else as_of(events, at, time)
    return project_state(current_events(known, id_column, supersedes) if id_column else known, keys, order, values)


def reason_code(payload: str = "payload", required: Sequence[str] = ()) -> Column:
    """Why an event may not be written, null if it may: the first rule that it breaks. A null never passes a rule.

    ``required``: columns that may not be null, beside those that the rules name.
    """
    reason = F.get_json_object(F.col(payload), "$.reason")
    none = F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0
    needs = F.col("event_type").isin([k for k, v in EVENT_TYPES.items() if v])
    excused = (F.col("event_type") == "DealStageChanged") & (F.col("actor_type") == "human") & (F.length(reason) > 0)
    unknown = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return (
        F.when(unknown("event_type", EVENT_TYPES), "unknown_event_type")
        .when(unknown("stream_type", STREAM_TYPES), "unknown_stream_type")
        .when(unknown("actor_type", ACTOR_TYPES), "unknown_actor_type")
        .when(missing, "missing_value")
        .when(F.try_parse_json(F.col(payload)).isNull(), "bad_payload")
        .when(needs & none & ~F.coalesce(excused, F.lit(False)), "no_evidence")
        .when(F.col("event_type").isin(*HUMAN_ONLY) & (F.col("actor_type") != "human"), "actor_not_human")
        .when((F.col("event_type") == "ClaimRetracted") & (F.coalesce(F.length(reason), F.lit(0)) == 0), "no_reason")
        .when((F.col("actor_type") == "agent") & F.col("proposal_id").isNull(), "agent_without_proposal")
    )


def frame_hash(df: DataFrame, buckets: int = 256) -> DataFrame:
    """One row (hash, rows): equal for equal multisets of rows, in any order and partitioning.

    Rows are hashed, sorted and hashed again within 65,536 buckets by their first four digits, then the buckets are; no array
    holds more than a bucket's share, and equal rows are one entry with their count.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    counted = df.select(row.alias("h")).groupBy("h").count()
    lists = counted.groupBy(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") % (buckets * 256)).agg(F.sort_array(F.collect_list(F.concat_ws(":", "h", "count"))).alias("x"), F.sum("count").alias("n"))
    parts = lists.select(F.element_at("x", 1).alias("first"), F.sha2(F.array_join("x", ","), 256).alias("h"), "n")
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "h"))), lambda x: x["h"]), ","), 256).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
