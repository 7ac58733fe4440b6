"""Projections to the stores and the tenant/window evidence query."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwarden.functions.eventjson import event_json
from trailwarden.operators.keyed import last_per_key



def evidence_key() -> Column:
    """Address of an event's document: tenant, then event."""
    return F.format_string("%s/%s.json", F.col("customerId"), F.col("eventId"))


def evidence_documents(events: DataFrame, *extra: str) -> DataFrame:
    """(evidence_key, document): the address and the full JSON of each event."""
    return events.select(*extra, evidence_key().alias("evidence_key"), event_json().alias("document"))


def latest_evidence(versions: DataFrame, order: Column) -> DataFrame:
    """The version that a read of each document returns: the last one written."""
    return last_per_key(versions, ["customerId", "eventId"], order)


def to_metadata(events: DataFrame, *extra: str) -> DataFrame:
    """The ten relational columns of an event."""
    return events.select(
        *extra,
        F.col("eventId").alias("event_id"),
        F.col("customerId").alias("customer_id"),
        F.col("userId").alias("user_id"),
        F.col("sessionId").alias("session_id"),
        F.col("timestamp").alias("occurred_at"),
        F.col("type").alias("event_type"),
        "resource",
        "action",
        F.col("riskLevel").alias("risk_level"),
        "anomalous",
    )


def instant(value: str | datetime) -> Column:
    """A literal instant from ISO text or an aware/UTC datetime."""
    if isinstance(value, datetime):
        value = value.isoformat()
    return F.to_timestamp(F.lit(value))


def utc_day(value: str | datetime) -> date:
    """The UTC day of ISO text or a datetime (a naive one is UTC)."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return (moment.astimezone(timezone.utc) if moment.tzinfo else moment).date()


def window_bounds(start, end) -> tuple[Column, Column]:
    """Both ends of a closed window, cut to whole seconds."""
    return F.date_trunc("second", instant(start)), F.date_trunc("second", instant(end))


def evidence_window(evidence: DataFrame, customer_id: str, start, end) -> DataFrame:
    """One tenant's evidence with ``event_time`` in the closed window.

    Bounds are cut to whole seconds first.  The tenant is a bound literal, so
    hostile text is just a tenant nobody has.
    """
    if customer_id is None:
        raise ValueError("customerId is required")
    low, high = window_bounds(start, end)
    scoped = evidence.where((F.col("customerId") == F.lit(customer_id)) & F.col("timestamp").between(low, high))
    return scoped.withColumn("event_time", F.col("timestamp"))


def evidence_query(evidence: DataFrame, customer_id: str, start, end) -> DataFrame:
    """``evidence_window`` in event-time order (id breaks ties)."""
    return evidence_window(evidence, customer_id, start, end).orderBy("event_time", "eventId")
