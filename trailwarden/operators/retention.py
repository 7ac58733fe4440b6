"""Retention of event metadata (evidence and topics are never purged)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwarden.operators.ranking import with_row_index

# --- Fixed values -----------------------------------------------------------
DEFAULT_DAYS = 400
DEFAULT_BATCH = 5000
# ----------------------------------------------------------------------------


def _at_least_one(name: str, value: int) -> int:
    if value < 1:
        raise ValueError(f"{name} must be >= 1, was {value}")
    return value


def cutoff_for(now: datetime, days: int = DEFAULT_DAYS) -> datetime:
    _at_least_one("days", days)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    return now - timedelta(days=days)


def _cutoff(now: datetime, days: int):
    return F.to_timestamp(F.lit(cutoff_for(now, days).isoformat()))


def expired(metadata: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    """Rows strictly older than the window."""
    return metadata.where(F.col("occurred_at") < _cutoff(now, days))


def kept(metadata: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    """What a finished purge leaves.  Ids are unique, so no join is needed."""
    return metadata.where(~F.coalesce(F.col("occurred_at") < _cutoff(now, days), F.lit(False)))


def after_one_statement(
    metadata: DataFrame, now: datetime, days: int = DEFAULT_DAYS, batch: int = DEFAULT_BATCH
) -> DataFrame:
    """What a single delete statement leaves: its oldest ``batch`` ids are gone."""
    victims = (
        expired(metadata, now, days)
        .orderBy("occurred_at", "event_id")
        .limit(_at_least_one("batch", batch))
        .select("event_id")
    )
    return metadata.join(F.broadcast(victims), "event_id", "left_anti")  # at most ``batch`` ids


def purge_summary(
    metadata: DataFrame, now: datetime, days: int = DEFAULT_DAYS, batch: int = DEFAULT_BATCH
) -> DataFrame:
    """Rows deleted, and statements issued until one comes back short."""
    _at_least_one("batch", batch)
    total = expired(metadata, now, days).agg(F.count("*").alias("deleted"))
    return total.select(
        "deleted", (F.floor(F.col("deleted") / F.lit(batch)) + 1).cast("bigint").alias("statements")
    )


def purge_batches(
    metadata: DataFrame, now: datetime, days: int = DEFAULT_DAYS, batch: int = DEFAULT_BATCH
) -> DataFrame:
    """The statement, counted from 0, that deletes each expired row."""
    _at_least_one("batch", batch)
    victims = expired(metadata, now, days).select("event_id", "occurred_at")
    ranked = with_row_index(victims, "occurred_at", "event_id")
    return ranked.withColumn("batch", F.floor(F.col("row_index") / F.lit(batch)).cast("bigint"))
