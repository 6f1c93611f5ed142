"""Approval, alerts, roles, erasure, and the state machines that fold events into a status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.model import APPROVAL, ROLES


def approval(event_type: Column, certainty: Column, confidence: Column, policy: Sequence[tuple] = APPROVAL) -> Column:
    """auto or review, by the first rule that fits; merges and whatever has no rule are reviewed."""
    out = F.lit("review")
    for kind, sure, least, decision in reversed(policy):
        fits = (event_type == kind) & (F.coalesce(confidence, F.lit(0.0)) >= least)
        out = F.when(fits if sure is None else fits & (certainty == sure), F.lit(decision)).otherwise(out)
    return out


def self_approvals(approvals: DataFrame, approver: str = "actor_id", creator: str = "created_by") -> DataFrame:
    """Approvals by the one who made the proposal, or with either unknown, which nobody can tell from that."""
    return approvals.filter(F.coalesce(F.col(approver) == F.col(creator), F.lit(True)))


def status(events: DataFrame, key: Sequence[str], order: Sequence[str], kind: str, moves: dict[str, str]) -> DataFrame:
    """The status that the last event of each key with a move leaves it in: ``moves`` maps event kinds to statuses."""
    table = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])
    moved = events.filter(F.col(kind).isin(*moves)).withColumn("status", F.try_element_at(table, F.col(kind)))
    return moved.groupBy(*key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n_events"))


def alert_timeline(events: DataFrame, key: Sequence[str], kind: str, time: str, raised: str, delivered: str, acknowledged: str, outcomes: Sequence[str]) -> DataFrame:
    """When each alert was first raised, delivered, acknowledged and decided, and how; seconds to acknowledgement."""
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(time)))
    decided = F.col(kind).isin(*outcomes)
    rows = events.groupBy(*key).agg(
        first(raised).alias("raised_at"),
        first(delivered).alias("delivered_at"),
        first(acknowledged).alias("acknowledged_at"),
        F.min(F.when(decided, F.struct(F.col(time).alias("at"), F.col(kind).alias("outcome")))).alias("o"),
    )
    rows = rows.filter(F.col("raised_at").isNotNull())
    seconds = F.timestamp_diff("SECOND", F.col("raised_at"), F.col("acknowledged_at"))
    return rows.select(*key, "raised_at", "delivered_at", "acknowledged_at", F.col("o.outcome").alias("outcome"), F.when(F.col("acknowledged_at") >= F.col("raised_at"), seconds).alias("ack_s"))


def can(role: Column, needed: Column) -> Column:
    """Whether a role has the rights of another: each has those of the ones before it."""
    rank = lambda r: F.array_position(F.array(*[F.lit(x) for x in ROLES]), r)
    return (rank(role) > 0) & (rank(needed) > 0) & (rank(role) >= rank(needed))


def seal(value: Column, key: Column) -> Column:
    """A field encrypted with its person's key (AES-GCM, random vector: write it once)."""
    return F.base64(F.aes_encrypt(value, key))


def unseal(people: DataFrame, keys: DataFrame, fields: Sequence[str], person: str = "person_id") -> DataFrame:
    """Personal fields in clear; null for people whose key is gone."""
    joined = people.join(keys.select(person, F.col("key").alias("__key")), person, "left")
    clear = lambda c: F.try_aes_decrypt(F.unbase64(c), F.col("__key")).cast("string")
    return joined.withColumns({c: clear(F.col(c)) for c in fields}).drop("__key")


def erase(keys: DataFrame, people: DataFrame, person: str = "person_id") -> DataFrame:
    """The keys without those of ``people``; whatever was sealed with them cannot be read again, and the log stays as it is."""
    return keys.join(people.select(person).distinct(), person, "left_anti")


def approve(proposals: DataFrame, approvals: DataFrame) -> DataFrame:
    """Events of approved proposals: ``approvals`` has proposal_id, actor_id, recorded_at, and payload if it was edited.

    Nobody approves their own proposal; one whose maker or approver is unknown is not approved. Evidence is that of the proposal;
    an edited one is an event of its editor. The id of an event depends on the proposal and its approver, so an approval that is
    sent twice is one event, once the store has it; what several people decide of one proposal is for :func:`settle`. Streams are
    those of the proposals (null where these name none, which the store refuses).
    """
    joined = proposals.join(approvals.withColumnsRenamed({"proposal_id": "id", "payload": "edited"}), "id").filter(F.col("actor_id") != F.col("created_by"))
    return joined.select(
        X.ulid_like(F.lit("approved"), F.col("id"), F.col("actor_id")).alias("id"),
        *_stream(proposals),
        F.col("id").alias("proposal_id"),
        "event_type",
        F.coalesce("edited", "payload").alias("payload"),
        "evidence_ids",
        "certainty",
        F.lit("human").alias("actor_type"),
        "actor_id",
        "recorded_at",
    )


def decisions(proposals: DataFrame, approvals: DataFrame, rejections: DataFrame, roles: DataFrame) -> DataFrame:
    """The first valid decision on each proposal: proposal_id, approved, actor_id, recorded_at, edited and reason.

    ``approvals``: proposal_id, actor_id, recorded_at, payload (null if it was not edited); ``rejections``: proposal_id, actor_id,
    recorded_at, reason; ``roles``: user_id, role. A decision counts if its actor has the rights of an approver in some role, did
    not make the proposal (whose maker must be known), and, for a rejection, gives a reason that is not blank. The earliest
    counts; at one time a rejection comes before an approval, then the lesser actor_id and text. Later decisions change nothing.
    """
    none = F.lit(None).cast("string")
    said = approvals.select("proposal_id", "actor_id", "recorded_at", F.lit(True).alias("approved"), F.col("payload").alias("edited"), none.alias("reason"))
    said = said.unionByName(rejections.filter(F.length(F.trim("reason")) > 0).select("proposal_id", "actor_id", "recorded_at", F.lit(False).alias("approved"), none.alias("edited"), "reason"))
    allowed = roles.filter(can(F.col("role"), F.lit("approver"))).select(F.col("user_id").alias("actor_id"))
    made = proposals.select(F.col("id").alias("proposal_id"), "created_by")
    valid = said.filter(F.col("recorded_at").isNotNull()).join(allowed, "actor_id", "left_semi").join(made, "proposal_id").filter(F.col("actor_id") != F.col("created_by"))
    first = valid.groupBy("proposal_id").agg(F.min(F.struct("recorded_at", "approved", "actor_id", "edited", "reason")).alias("d"))
    return first.select("proposal_id", "d.approved", "d.actor_id", "d.recorded_at", "d.edited", "d.reason")


def settle(proposals: DataFrame, approvals: DataFrame, rejections: DataFrame, roles: DataFrame) -> DataFrame:
    """Events of the proposals whose first valid decision (:func:`decisions`) approves them.

    The id of an event depends on its proposal alone, so the store takes one of them whatever is decided later, in this batch or
    another: the same again is skipped, anything else is refused. Evidence is that of the proposal, the actor is the approver.
    """
    found = decisions(proposals, approvals, rejections, roles).filter("approved").withColumnRenamed("proposal_id", "id")
    return proposals.join(found, "id").select(
        X.ulid_like(F.lit("decided"), F.col("id")).alias("id"),
        *_stream(proposals),
        F.col("id").alias("proposal_id"),
        "event_type",
        F.coalesce("edited", "payload").alias("payload"),
        "evidence_ids",
        "certainty",
        F.lit("human").alias("actor_type"),
        "actor_id",
        "recorded_at",
    )


def _stream(proposals: DataFrame) -> list[Column]:
    return [(F.col(c) if c in proposals.columns else F.lit(None).cast("string")).alias(c) for c in ("stream_type", "stream_id")]


def routed(proposals: DataFrame, policy: Sequence[tuple] = APPROVAL) -> DataFrame:
    """Proposals with ``decision``: auto or review."""
    return proposals.withColumn("decision", approval(F.col("event_type"), F.col("certainty"), F.col("confidence"), policy))


def auto_approve(proposals: DataFrame, policy: Sequence[tuple] = APPROVAL) -> DataFrame:
    """Events of the proposals that the policy lets through: of the agent that made them, at the time they were made."""
    return routed(proposals, policy).filter("decision = 'auto'").select(
        X.ulid_like(F.lit("auto"), F.col("id")).alias("id"),
        *_stream(proposals),
        F.col("id").alias("proposal_id"),
        "event_type",
        "payload",
        "evidence_ids",
        "certainty",
        F.lit("agent").alias("actor_type"),
        F.col("created_by").alias("actor_id"),
        F.col("created_at").alias("recorded_at"),
    )


#: What is kept of a business contact.
CONTACT = ("name", "role", "organisation", "business_email", "business_phone", "source")


def contact_fields(contacts: DataFrame) -> DataFrame:
    """Contacts without anything but their business fields."""
    return contacts.select(*CONTACT)


def alert_events(signals: DataFrame, tier: str = "tier", at: Column | None = None) -> DataFrame:
    """AlertRaised events of the Tier 0 signals (id, stream_type, stream_id, evidence_ids, recorded_at), status unconfirmed."""
    return signals.filter(F.col(tier) == 0).select(
        X.ulid_like(F.lit("alert"), F.col("id")).alias("id"),
        "stream_type",
        "stream_id",
        F.lit("AlertRaised").alias("event_type"),
        F.to_json(F.struct(F.col("id").alias("signal_id"), F.lit("unconfirmed").alias("status"))).alias("payload"),
        "evidence_ids",
        F.lit("system").alias("actor_type"),
        F.lit("alerts").alias("actor_id"),
        (F.col("recorded_at") if at is None else at).alias("recorded_at"),
    )


def expire_texts(sources: DataFrame, now: Column, days: int, text: str = "text") -> DataFrame:
    """Texts under verify_then_purge that are older than ``days`` become null; hashes and quotes stay."""
    old = (F.col("retention_policy") == "verify_then_purge") & (F.date_add(F.col("fetched_at").cast("date"), days) < now)
    return sources.withColumn(text, F.when(~F.coalesce(old, F.lit(False)), F.col(text)))


def visible_status(certainty: Column, alert_status: Column) -> Column:
    return F.when(alert_status == "unconfirmed", "Unconfirmed").when(alert_status == "dismissed", "Dismissed").when(certainty == "reported", "Reported").when(certainty == "speculative", "Speculative").otherwise("Confirmed")
