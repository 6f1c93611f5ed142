"""Schemas, ordered domains and reason codes of the event log.

Types are this library's choice where the model only names columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i, _b, _t, _d = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DoubleType()
_strings = T.ArrayType(_s)
GEOMETRY = T.StructType([T.StructField(n, t) for n, t in (("kind", _s), ("lon", _d), ("lat", _d), ("wkt", _s), ("approximate", _b), ("evidence_id", _s))])


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SOURCE = _schema(
    ("id", _s), ("type", _s), ("url", _s), ("publisher", _s), ("published_at", _t), ("fetched_at", _t), ("licence_code", _s), ("retention_policy", _s),
    ("brief_version_id", _s), ("content_hash", _s), ("simhash", _l), ("duplicate_of", _s), ("raw_uri", _s), ("text_uri", _s), ("page_map", T.ArrayType(_i)),
    ("language", _s), ("ocr", _b), ("read_at_source", _b),
)
SOURCE_URL = _schema(("source_id", _s), ("url", _s), ("seen_at", _t))
EVIDENCE = _schema(("id", _s), ("source_id", _s), ("char_start", _i), ("char_end", _i), ("quote", _s), ("quote_hash", _s), ("verified", _b))
ENTITY = _schema(("id", _s), ("type", _s), ("site_class", _s), ("watch", _s), ("geometry", GEOMETRY), ("external_ids", T.MapType(_s, _s)))
EVENT = _schema(
    ("id", _s), ("stream_type", _s), ("stream_id", _s), ("sequence", _l), ("event_type", _s), ("payload", _s), ("evidence_ids", _strings), ("certainty", _s),
    ("actor_type", _s), ("actor_id", _s), ("model_id", _s), ("prompt_version", _s), ("proposal_id", _s), ("brief_version_id", _s), ("supersedes_event_id", _s),
    ("recorded_at", _t), ("prev_hash", _s), ("hash", _s),
)
PROPOSAL = _schema(("id", _s), ("stream_type", _s), ("stream_id", _s), ("event_type", _s), ("payload", _s), ("evidence_ids", _strings), ("certainty", _s), ("confidence", _d), ("created_by", _s), ("created_at", _t))
QUARANTINE = _schema(("id", _s), ("step", _s), ("output", _s), ("reason_code", _s), ("created_at", _t))
MODEL_CALL = _schema(("id", _s), ("model_id", _s), ("prompt_version", _s), ("input_hash", _s), ("output", _s), ("tokens", _l), ("latency_s", _d))
TEXT = _schema(("source_id", _s), ("text_uri", _s), ("text", _s), ("content_hash", _s))
HEAD = _schema(("stream_type", _s), ("stream_id", _s), ("head", _l), ("hash", _s))
SECURITY_LOG = _schema(("ts", _t), ("user_id", _s), ("action", _s), ("detail", _s))
COLLECTOR_RUN = _schema(("source_key", _s), ("started_at", _t), ("ok", _b), ("attempts", _i), ("documents", _i))
PERSON_KEY = _schema(("person_id", _s), ("key", T.BinaryType()))

#: Event types, each with whether it needs evidence.
EVENT_TYPES: dict[str, bool] = {
    "EntityIdentified": True,
    "EntityAttributeAsserted": True,
    "EntityMerged": True,
    "EntitySplit": True,
    "RelationshipAsserted": True,
    "DealIdentified": True,
    "DealAttributeAsserted": True,
    "DealStageChanged": True,
    "SignalScored": True,
    "DemandDriverObserved": True,
    "ProjectStageChanged": True,
    "ProcurementWindowForecast": True,
    "DemandEstimated": True,
    "ContactAdded": False,
    "TouchpointLogged": False,
    "NextActionSet": False,
    "PrequalificationStatusChanged": False,
    "SiteStatusChanged": True,
    "AlertRaised": True,
    "AlertConfirmed": True,
    "AlertDismissed": True,
    "AlertAcknowledged": False,
    "ClaimRetracted": False,
}
#: Event types that only a person may write.
HUMAN_ONLY = ("ContactAdded", "TouchpointLogged", "NextActionSet", "PrequalificationStatusChanged")
#: The stages of a deal in order.
DEAL_STAGES = (
    "Signal", "Qualified", "Contact found", "Approach", "Relationship active", "Prequalification", "Tender or proposal", "Negotiation", "Won", "Lost", "Parked",
)
#: The stages of a project in which its buyers can be engaged, both included.
ENGAGEMENT_WINDOW = (4, 8)
#: Buyer roles, certainties, retention policies, roles of users from least to most.
BUYER_ROLES = ("owner", "EPC contractor", "mining contractor", "haulage contractor", "fuel supplier of record")
CERTAINTIES = ("stated", "reported", "speculative")
RETENTION = ("full", "verify_then_purge", "link_only")
ROLES = ("viewer", "analyst", "approver", "admin")
STREAM_TYPES = ("entity", "deal", "market", "proposal")
ACTOR_TYPES = ("agent", "human", "system")

#: Kinds of entities, classes of sites, how closely an entity is watched.
ENTITY_TYPES = ("organisation", "person", "site", "project", "opportunity", "location")
SITE_CLASSES = ("mine", "exploration", "farm", "power", "industrial", "transport", "border", "fuel_supply")
WATCH = ("daily", "weekly", "none")

#: Default approval policy: (event type, certainty or None for any, least confidence, decision). Where nothing fits: review.
APPROVAL: tuple[tuple[str, str | None, float, str], ...] = (
    ("SignalScored", None, 0.0, "auto"),
    ("EntityIdentified", None, 0.9, "auto"),
    ("EntityAttributeAsserted", "stated", 0.0, "auto"),
    ("DemandDriverObserved", "stated", 0.0, "auto"),
    ("ProjectStageChanged", "stated", 0.0, "auto"),
    ("ProcurementWindowForecast", None, 0.0, "auto"),
    ("ContactAdded", None, 0.0, "auto"),
    ("TouchpointLogged", None, 0.0, "auto"),
    ("NextActionSet", None, 0.0, "auto"),
    ("PrequalificationStatusChanged", None, 0.0, "auto"),
    ("AlertRaised", None, 0.0, "auto"),
    ("AlertAcknowledged", None, 0.0, "auto"),
)

#: Reason codes of rejected rows.
REASONS = (
    "unknown_event_type", "no_evidence", "actor_not_human", "no_reason", "agent_without_proposal", "bad_payload", "bad_span", "value_not_in_quote", "quote_too_long",
    "unknown_code", "unknown_predicate", "self_approval", "unknown_stream_type", "unknown_actor_type", "missing_value", "duplicate_id",
    "unknown_type", "unknown_site_class", "class_without_site", "unknown_watch", "bad_point", "bad_shape", "place_without_evidence",
)
