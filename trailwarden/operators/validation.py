"""Request and column checks; nothing is dropped, rows are split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwarden.functions.eventjson import empty_controls, empty_tags
from trailwarden.functions.text import is_missing
from trailwarden.schemas import (
    EVENT_COLUMNS,
    EVENT_TYPES,
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    REQUEST,
    TABLES,
)


def reject_reason(with_timestamp: bool = True) -> Column:
    """First failing check, or null.  Order: id, tenant, type, time."""
    reason = (
        F.when(is_missing(F.col("eventId")), F.lit("eventId is required"))
        .when(is_missing(F.col("customerId")), F.lit("customerId is required"))
        .when(F.col("type").isNull(), F.lit("type is required"))
        .when(~F.col("type").isin(*EVENT_TYPES), F.lit("invalid type"))
    )
    if with_timestamp:
        reason = reason.when(F.col("timestamp").isNull(), F.lit("timestamp is required"))
    return reason


def normalize_requests(requests: DataFrame, ingest_ts: Column) -> DataFrame:
    """Request rows as events with a ``reject_reason``; time is the ingest time.

    The wire form carries no risk level, location, controls or tags, so those
    take their defaults.
    """
    extra = [c for c in requests.columns if c not in EVENT_COLUMNS]
    fixed = {
        "timestamp": ingest_ts,
        "location": F.lit(None).cast("string"),
        "controls": empty_controls(),
        "riskLevel": F.lit("LOW"),
        "anomalous": F.lit(False),
        "tags": empty_tags(),
    }
    have = set(requests.columns)
    absent = {c: F.lit(None).cast("string") for c in REQUEST.fieldNames() if c not in have}
    fixed |= absent
    events = requests.select(*extra, *[fixed.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS])
    return events.withColumn("reject_reason", reject_reason())


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull())


def violated_column(table: str = "audit_events") -> Column:
    """First column of the table whose constraint the row breaks, or null."""
    broken = []
    for name, (nullable, limit) in TABLES[table].items():
        tests = [] if nullable else [F.col(name).isNull()]
        if limit is not None:
            tests.append(F.coalesce(F.length(name) > limit, F.lit(False)))
        if tests:
            broken.append(F.when(reduce(Column.__or__, tests), F.lit(name)))
    return F.coalesce(*broken)


def split_rows(rows: DataFrame, table: str = "audit_events") -> tuple[DataFrame, DataFrame]:
    """(insertable rows, rows with the ``violated`` column name)."""
    checked = rows.withColumn("violated", violated_column(table))
    good = checked.where(F.col("violated").isNull()).drop("violated")
    return good, checked.where(F.col("violated").isNotNull())


def orphans(child: DataFrame, parent: DataFrame, child_table: str) -> DataFrame:
    """Child rows whose foreign key is set and has no parent row."""
    key, _ = FOREIGN_KEYS[child_table]
    present = child.where(F.col(key).isNotNull())
    return present.join(parent.select(key).distinct(), key, "left_anti")


def duplicate_keys(rows: DataFrame, table: str) -> DataFrame:
    """Primary-key values that occur more than once."""
    return rows.groupBy(*PRIMARY_KEYS[table]).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
