"""Batch jobs a user runs end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.functions.eventjson import decode_events
from trailwarden.operators.enrich import Step, enrich
from trailwarden.operators.evidence import to_metadata
from trailwarden.operators.keyed import insert_if_absent
from trailwarden.operators.matching import build_alerts
from trailwarden.operators.reports import ordered_report, report_document
from trailwarden.sinks.tables import (
    Stores,
    default_sinks,
    fan_out_decoded,
    read_evidence_window,
)
from trailwarden.sources.events import decoded
from trailwarden.sources.querylog import log_events


def enrich_records(records: DataFrame, steps: list[Step] | None = None) -> DataFrame:
    """Raw JSON records to enriched events."""
    return enrich(decoded(records), steps)


def alerts_for(records: DataFrame, rules: DataFrame, **build) -> DataFrame:
    """Raw JSON records to outbox rows."""
    return build_alerts(enrich_records(records), rules, **build)


def store_records(
    records: DataFrame, stores: Stores, rules: DataFrame | None = None, writer: str | None = None, batch: int = 0
) -> Stores:
    """One batch of raw records through enrichment into every store; gives the stores as its writer sees them.

    Without a writer's name each call is a batch of its own. With one, the same
    (writer, batch) again is a replay and replaces what it wrote before.
    Records that do not decode end up in the quarantine table.
    """
    mine = stores.of(writer or f"load-{uuid.uuid4().hex}")
    fan_out_decoded(decode_events(records), mine, default_sinks(mine, rules), batch)
    return mine


def log_metadata(
    log: DataFrame, customer_id: str, resource: str, stored: DataFrame | None = None
) -> DataFrame:
    """A query log to the metadata rows it would add."""
    rows = to_metadata(enrich(log_events(log, customer_id, resource)))
    # Rows that share an id are equal, so which of them stays does not matter.
    return insert_if_absent(rows, stored, "event_id", F.col("occurred_at"))


def framework_report(
    spark: SparkSession, stores: Stores, framework: str, customer_id: str, start, end
) -> DataFrame:
    """A tenant's report for a period, as ordered lines; the evidence is read once."""
    events = read_evidence_window(spark, stores, customer_id, start, end)
    return ordered_report(report_document(events, framework, customer_id, start, end))


def write_report(report: DataFrame, path: str) -> None:
    """UTF-8 text; the files in name order are the document."""
    report.write.mode("overwrite").text(path)
