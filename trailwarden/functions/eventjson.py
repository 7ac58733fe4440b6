"""Events to and from their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwarden.functions.text import iso_instant, parse_instant
from trailwarden.schemas import (
    AUDIT_EVENT,
    AUDIT_EVENT_WIRE,
    CORRUPT,
    EVENT_COLUMNS,
    EVENT_TYPES,
    RISK_LEVELS,
)

_PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def event_json() -> Column:
    """The whole event as one JSON object; null fields are written out."""
    fields = [
        iso_instant(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in EVENT_COLUMNS
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def empty_controls() -> Column:
    return F.array().cast(AUDIT_EVENT["controls"].dataType)


def empty_tags() -> Column:
    return F.create_map().cast(AUDIT_EVENT["tags"].dataType)


def decode_events(records: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON records into event columns plus a nullable ``decode_error``.

    Other input columns are kept, so good and bad rows can both be traced.
    """
    # A generator keeps the parse a step of its own: filters on decoded columns
    # then never push copies of it down, and each record is parsed once.
    parsed = F.from_json(F.col(value), AUDIT_EVENT_WIRE, _PARSE)
    wire = records.select("*", F.inline(F.array(parsed)))
    w = {name: F.col(name) for name in AUDIT_EVENT_WIRE.fieldNames()}
    instant = parse_instant(w["timestamp"])
    # A level that is absent defaults to LOW; one sent as an explicit null stays
    # unrated.  The second look at the text only happens for null levels.
    keys = F.json_object_keys(F.col(value))
    level = F.coalesce(
        w["riskLevel"],
        F.when(~F.coalesce(F.array_contains(keys, "riskLevel"), F.lit(False)), F.lit("LOW")),
    )
    error = (
        F.when(F.col(value).isNull() | w[CORRUPT].isNotNull(), F.lit("malformed json"))
        .when(w["eventId"].isNull(), F.lit("eventId is required"))
        .when(w["customerId"].isNull(), F.lit("customerId is required"))
        .when(w["type"].isNull(), F.lit("type is required"))
        .when(w["timestamp"].isNull(), F.lit("timestamp is required"))
        .when(~w["type"].isin(*EVENT_TYPES), F.lit("invalid type"))
        .when(~w["riskLevel"].isin(*RISK_LEVELS), F.lit("invalid riskLevel"))
        .when(instant.isNull(), F.lit("invalid timestamp"))
    )
    derived = {
        "timestamp": instant,
        "riskLevel": level,
        "anomalous": F.coalesce(w["anomalous"], F.lit(False)),
        "controls": F.coalesce(w["controls"], empty_controls()),
        "tags": F.coalesce(w["tags"], empty_tags()),
    }
    kept = [c for c in records.columns if c not in EVENT_COLUMNS]
    return wire.select(
        *kept,
        *[derived.get(c, w[c]).alias(c) for c in EVENT_COLUMNS],
        error.alias("decode_error"),
    )


__all__ = ["decode_events", "empty_controls", "empty_tags", "event_json"]
