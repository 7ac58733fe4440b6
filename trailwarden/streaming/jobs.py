"""Continuous jobs.

Each job is the batch operators on a streaming source.  Positions live in the
query checkpoint and advance only after a batch is written, so delivery is at
least once and the batch-id overwrite of the tables makes it exactly once there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailwarden.functions.eventjson import decode_events
from trailwarden.operators.enrich import Step
from trailwarden.operators.evidence import to_metadata
from trailwarden.operators.matching import prepare_rules
from trailwarden.operators.validation import accepted, normalize_requests, rejected
from trailwarden.sinks.folders import folders
from trailwarden.sinks.tables import (
    Sink,
    Stores,
    default_sinks,
    fan_out,
    fan_out_decoded,
    in_tenant_order,
    topic_records,
    write_alerts,
    write_metadata,
)
from trailwarden.sources.querylog import log_events, wire_requests


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start ``handle`` on each micro-batch.

    ``every`` (e.g. "15 seconds") polls continuously; without it the query takes
    what is available and stops.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def enrichment_stream(
    records: DataFrame,
    stores: Stores,
    checkpoint: str,
    rules: DataFrame | None = None,
    steps: list[Step] | None = None,
    sinks: list[Sink] | None = None,
    every: str | None = None,
    writer: str = "enrichment",
) -> StreamingQuery:
    """Raw records -> enriched events -> every sink; bad records are set aside."""
    prepared = None if rules is None else prepare_rules(rules)
    mine = stores.of(writer)
    targets = default_sinks(mine, prepared) if sinks is None else sinks

    def handle(batch: DataFrame, batch_id: int) -> None:
        fan_out_decoded(decode_events(batch), mine, targets, batch_id, steps)

    return run_batches(records, handle, checkpoint, every)


def alert_stream(
    enriched_records: DataFrame,
    rules: DataFrame,
    stores: Stores,
    checkpoint: str,
    every: str | None = None,
    writer: str = "alerting",
    **build,
) -> StreamingQuery:
    """Enriched records -> outbox, one stream-static join per micro-batch.

    Records that do not decode go to the quarantine table, as in enrichment.
    """
    prepared, mine = prepare_rules(rules), stores.of(writer)
    alerts = Sink("alerts", lambda df, b: write_alerts(df, prepared, mine, b, **build))

    def handle(batch: DataFrame, batch_id: int) -> None:
        fan_out_decoded(decode_events(batch), mine, [alerts], batch_id, [])

    return run_batches(enriched_records, handle, checkpoint, every)


def into_sinks(sinks: list[Sink]) -> Callable[[DataFrame, int], None]:
    """A batch handler that fans out to sinks."""
    return lambda batch, batch_id: fan_out(batch, sinks, batch_id)


def arrival_order(batch_id: int) -> Column:
    """Numbers that grow from batch to batch and, within a batch, in reading order.

    40 bits for the rows of a batch, at most 8,192 tasks of 2 ** 27 rows; a batch
    beyond that fails instead of losing its order.
    """
    row = F.monotonically_increasing_id()
    task, place = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (task < 1 << 13) & (place < 1 << 27)
    number = F.lit(batch_id << 40) + F.shiftleft(task, 27) + place
    return F.when(fits, number).otherwise(F.raise_error(F.lit("a batch this large has no order; take smaller ones")).cast("bigint"))


def log_stream(
    log: DataFrame,
    customer_id: str,
    resource: str,
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Query-log rows -> redacted events.  An all-noise batch still advances.

    ``deliver`` gets the query's own batch number; see ``into_sinks``.
    """
    return run_batches(log_events(log, customer_id, resource), deliver, checkpoint, every)


def forward_stream(log: DataFrame, customer_id: str, resource: str, landing: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Query-log rows -> wire requests as JSON lines in a landing folder, which ``request_files`` reads.

    A batch lands once: its folder is complete or absent for readers of
    committed files, and a replay of a complete one writes nothing, so the next
    stream does not see it as new. An unfinished one is written anew.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}"
        if not folders(batch.sparkSession, landing, name, below="_SUCCESS"):
            batch.write.mode("overwrite").json(f"{landing.rstrip('/')}/{name}")

    events = log_events(log, customer_id, resource)
    return run_batches(wire_requests(events.drop("seq")), land, checkpoint, every)


def ingest_stream(
    requests: DataFrame,
    ingest_ts: Callable[[], object],
    stores: Stores,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Landed requests -> raw topic records and a table of rejects."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = normalize_requests(batch, ingest_ts()).persist()  # read once for both tables
        try:
            good = in_tenant_order(accepted(checked).withColumn("seq", arrival_order(batch_id)))
            topic_records(good).write.mode("overwrite").parquet(
                f"{stores.path('raw')}/batch_id={batch_id}"
            )
            rejected(checked).drop("controls", "tags").write.mode("overwrite").parquet(
                f"{stores.path('rejects')}/batch_id={batch_id}"
            )
        finally:
            checked.unpersist()

    return run_batches(requests, handle, checkpoint, every)


def metadata_stream(
    events: DataFrame,
    stores: Stores,
    checkpoint: str,
    every: str | None = None,
    writer: str = "metadata",
) -> StreamingQuery:
    """Insert-if-absent over the earlier batches (see ``write_metadata``)."""
    sink = Sink("metadata", lambda df, b: write_metadata(df, stores.of(writer), b))
    return run_batches(events, into_sinks([sink]), checkpoint, every)


def recent_unique(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """Bounded-state variant: copies of an id within ``keep`` of each other.

    State is one row per recent id, spread over the shuffle partitions. Time is
    that of arrival: an event may be as old as it likes when it first comes, for
    nothing arrives late by the clock. Copies that arrive further apart than
    ``keep`` pass, so pair it with the exact store.
    """
    rows = to_metadata(events).withColumn("_arrived", F.current_timestamp())
    return rows.withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")
