"""File tables behind the stores.

Every writer counts its own batches and overwrites just its own partitions, so a
batch that is replayed after a failure leaves the tables as if it ran once, and
no writer touches what another wrote. Order over writers is that of arrival, a
column written with the rows.

Layouts
  evidence   event_date / writer / batch_id   all versions, sorted by tenant and time
  versions   tenants / writer / batch_id      ids and order of all versions, by hashed tenant
  metadata   event_date / writer / batch_id   first write per event id
  ids        bucket / writer / batch_id       the ids in metadata (see ``idindex``)
  enriched   writer / batch_id                keyed JSON records
  alerts     writer / batch_id                outbox rows
  quarantine writer / batch_id                records that did not decode
  violations writer / batch_id                rows the metadata table refuses

Small folders of many batches are merged (see ``compaction``) into folders of a
writer of its own, whose rows name the writer and batch they are from. A batch
that has a folder of its own counts by that folder alone, so a replay after a
merge replaces what was merged, and a merge cut off half way changes nothing.

Evidence has no folder per tenant: their number would grow with the tenants and
with every batch. Its rows are sorted by tenant and time instead, so the Parquet
statistics let a tenant's query skip the rest. ``rebalance`` gathers the rows of
a tenant and day: adaptive execution splits a dominant one and merges small ones,
and nothing is sampled, so a batch is computed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailwarden.functions.eventjson import event_json
from trailwarden.operators.enrich import Step, enrich
from trailwarden.operators.evidence import (
    evidence_window,
    latest_evidence,
    to_metadata,
    utc_day,
    window_bounds,
)
from trailwarden.operators.keyed import first_per_key
from trailwarden.operators.matching import PreparedRules, build_alerts
from trailwarden.operators.validation import split_rows
from trailwarden.schemas import ALERT, AUDIT_EVENT, EVENT_COLUMNS, METADATA
from trailwarden.sinks.folders import folders
from trailwarden.sinks.idindex import MERGED, IdIndex
from trailwarden.sources.events import RECORD


@dataclass(frozen=True)
class Stores:
    """Locations of the tables under one root, and who writes.

    ``period`` is the length of an ``event_date`` folder: day, week, month or
    year.  Days suit terabytes a week; a small store over many years wants
    longer ones. ``buckets`` is the number of id and tenant buckets, fixed for
    the life of a store. A writer's name outlives its checkpoints: one that
    starts anew from an empty checkpoint must take a new name.
    """

    root: str
    period: str = "day"
    writer: str = "main"
    buckets: int = 32

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", self.writer):
            raise ValueError(f"a writer's name has letters, digits, dots and hyphens: {self.writer!r}")

    def of(self, writer: str) -> "Stores":
        """The same tables, written by another."""
        return replace(self, writer=writer)

    def ids(self) -> IdIndex:
        return IdIndex(self.path("ids"), self.buckets)

    def tenants(self, customer_id: Column) -> Column:
        """The bucket of the version log that a tenant is in."""
        return F.pmod(F.xxhash64(customer_id), F.lit(self.buckets)).cast("int")

    def event_date(self, ts: str) -> Column:
        """First day of the period an instant falls in."""
        return F.to_date(F.date_trunc(self.period, F.col(ts)))

    def first_day(self, day: date) -> date:
        starts = {
            "day": day,
            "week": day - timedelta(days=day.weekday()),
            "month": day.replace(day=1),
            "year": day.replace(month=1, day=1),
        }
        return starts[self.period]

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


_BATCH = [("writer", "string"), ("batch_id", "bigint")]
_PARTITIONS = {
    "evidence": [("event_date", "date"), *_BATCH],
    "versions": [("tenants", "int"), *_BATCH],
    "metadata": [("event_date", "date"), *_BATCH],
    "enriched": _BATCH,
    "alerts": _BATCH,
    "quarantine": _BATCH,
    "violations": _BATCH,
}
_SEQ = T.StructType([T.StructField("seq", T.LongType())])
_ERROR = T.StructType([T.StructField("decode_error", T.StringType())])
_VIOLATED = T.StructType([T.StructField("violated", T.StringType())])
_ARRIVED = T.StructType([T.StructField("arrived", T.TimestampType())])
#: Versions of a document in the order of their writing.
WRITTEN = ("arrived", "writer", "batch_id", "seq")
_SCHEMAS = {
    "evidence": T.StructType(_ARRIVED.fields + _SEQ.fields + AUDIT_EVENT.fields),
    "versions": T.StructType(_ARRIVED.fields + _SEQ.fields + [AUDIT_EVENT[c] for c in ("customerId", "eventId", "timestamp")]),
    "metadata": METADATA,
    "enriched": RECORD,
    "alerts": ALERT,
    "quarantine": T.StructType(RECORD.fields + _ERROR.fields),
    "violations": T.StructType(METADATA.fields + _VIOLATED.fields),
}


#: Tables whose folders are merged, and how their files are sorted.
SORTED = {
    "evidence": ("event_date", "customerId", "timestamp"),
    "versions": ("tenants", "customerId", "timestamp"),
    "metadata": ("event_date", "occurred_at"),
}
_ORIGIN = T.StructType([T.StructField("of_writer", T.StringType()), T.StructField("of_batch", T.LongType())])
#: Folders listed to set replayed batches apart are broadcast up to this number, some 100 bytes each.
BROADCAST_FOLDERS = 100_000
#: Fixed value: what stands for null in a folder's name.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def table_schema(table: str, merged: bool = False) -> T.StructType:
    keys = [T.StructField(n, T._parse_datatype_string(t)) for n, t in _PARTITIONS[table]]
    return T.StructType(_SCHEMAS[table].fields + (_ORIGIN.fields if merged else []) + keys)


class BatchFolder(NamedTuple):
    """What a batch, or a merge, wrote to one day or tenant bucket."""

    head: str
    writer: str
    batch: int

    @property
    def name(self) -> str:
        return f"{self.head}/writer={self.writer}/batch_id={self.batch}"


def batch_folders(spark: SparkSession, stores: Stores, table: str, writer: str = "*") -> list[BatchFolder]:
    key = _PARTITIONS[table][0][0]
    found = (n.split("/") for n in folders(spark, stores.path(table), f"{key}=", below=f"writer={writer}/batch_id=*"))
    return [BatchFolder(h, w.removeprefix("writer="), int(b.removeprefix("batch_id="))) for h, w, b in found]


def read_folders(spark: SparkSession, stores: Stores, table: str, names: list[str], merged: bool = False) -> DataFrame:
    root, schema = stores.path(table), table_schema(table, merged)
    reader = spark.read.schema(schema).option("basePath", root)
    return reader.parquet(*[f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def merged_rows(spark: SparkSession, stores: Stores, table: str, merges: list[BatchFolder], single: list[BatchFolder]) -> DataFrame:
    """Merged rows under the writer and batch they are from.

    Of the merges of a day or bucket the last counts; batches among ``single``
    have a folder of their own there and are left out.
    """
    key = _PARTITIONS[table][0][0]
    newest: dict[str, BatchFolder] = {}
    for f in merges:
        newest[f.head] = max(f, newest.get(f.head, f))
    rows = read_folders(spark, stores, table, [f.name for f in newest.values()], merged=True)
    rows = rows.withColumns({"writer": F.col("of_writer"), "batch_id": F.col("of_batch")}).drop("of_writer", "of_batch")
    beside = [tuple(f) for f in single if f.head in newest]
    if not beside:
        return rows
    listed = spark.createDataFrame(beside, "_head string, _writer string, _batch bigint")
    head = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit(NO_VALUE)))
    same = (head == F.col("_head")) & (F.col("writer") == F.col("_writer")) & (F.col("batch_id") == F.col("_batch"))
    return rows.join(F.broadcast(listed) if len(beside) <= BROADCAST_FOLDERS else listed, same, "left_anti")


def day_folders(
    spark: SparkSession, stores: Stores, table: str, first: date | None = None, last: date | None = None
) -> list[str]:
    """Names of a dated table's top folders in a range: one short listing."""
    low, high = f"event_date={first or date.min}", f"event_date={last or date.max}"
    return [n for n in folders(spark, stores.path(table), "event_date=") if low <= n <= high]


def read_table(
    spark: SparkSession, stores: Stores, table: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """A table with its declared schema; empty before the first write.

    With ``first`` / ``last`` only the folders in that range are even listed,
    which keeps a short read short on a table with years of batches.
    """
    schema = table_schema(table)
    root = stores.path(table)
    names = day_folders(spark, stores, table, first, last) if first or last else None
    if names is not None:
        rows = read_folders(spark, stores, table, names)
    else:
        try:
            rows = spark.read.schema(schema).parquet(root)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return spark.createDataFrame([], schema)
            raise
    wanted = lambda found: [f for f in found if names is None or f.head in set(names)]
    merges = wanted(batch_folders(spark, stores, table, MERGED)) if table in SORTED else []
    if not merges:
        return rows
    single = [f for f in wanted(batch_folders(spark, stores, table)) if f.writer != MERGED]
    return rows.where(F.col("writer") != MERGED).unionByName(merged_rows(spark, stores, table, merges, single))


def _write(df: DataFrame, stores: Stores, table: str, batch_id: int) -> None:
    keys = [name for name, _ in _PARTITIONS[table]]
    (
        df.withColumns(_own(stores, batch_id)).select(*_SCHEMAS[table].fieldNames(), *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(stores.path(table))
    )


def _own(stores: Stores, batch_id: int) -> dict[str, Column]:
    return {"writer": F.lit(stores.writer), "batch_id": F.lit(batch_id).cast("bigint")}


def _with_seq(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else df.withColumn("seq", F.lit(0).cast("bigint"))


def write_evidence(events: DataFrame, stores: Stores, batch_id: int) -> DataFrame:
    """Append every version of every event; gives the rows as they are stored."""
    spark = events.sparkSession
    dated = _with_seq(events).withColumns({"event_date": stores.event_date("timestamp"), "arrived": F.current_timestamp()})
    placed = dated.hint("rebalance", "event_date", "customerId").sortWithinPartitions("event_date", "customerId", "timestamp")
    _write(placed, stores, "evidence", batch_id)
    stored = _own_rows(spark, stores, "evidence", batch_id)
    tenants = stored.withColumn("tenants", stores.tenants(F.col("customerId")))
    _write(tenants.hint("rebalance", "tenants").sortWithinPartitions("tenants", "customerId", "timestamp"), stores, "versions", batch_id)
    return stored.select("seq", *EVENT_COLUMNS)


def _own_rows(spark: SparkSession, stores: Stores, table: str, batch_id: int) -> DataFrame:
    """What a batch wrote to a dated table, from its own folders alone."""
    names = folders(spark, stores.path(table), "event_date=", below=f"writer={stores.writer}/batch_id={batch_id}")
    return read_folders(spark, stores, table, names)


def _any(seen: Observation, name: str) -> bool:
    """Whether an observed count is above 0; true if the plan was cut down to nothing and the count with it."""
    try:
        return bool(seen.get[name])
    except Py4JJavaError:  # adaptive execution leaves no metrics of an empty result
        return True


def read_evidence(spark: SparkSession, stores: Stores) -> DataFrame:
    """The latest version of each (tenant, event)."""
    versions = read_table(spark, stores, "evidence").drop("event_date")
    return latest_evidence(versions, F.struct(*WRITTEN)).select(*EVENT_COLUMNS)


def read_evidence_window(spark: SparkSession, stores: Stores, customer_id: str, start, end) -> DataFrame:
    """Latest versions of one tenant's events in a window.

    Whole documents are read for the window's days only.  Whether a version was
    replaced by one outside the window is decided on the version log, of which
    the tenant's bucket is read.
    """
    first, last = (stores.first_day(utc_day(t)) for t in (start, end))
    order = F.struct(*WRITTEN)
    recent = read_table(spark, stores, "evidence", first, last).withColumn("_order", order)
    latest = latest_evidence(evidence_window(recent, customer_id, start, end), F.col("_order"))
    low, high = window_bounds(start, end)
    mine = (F.col("tenants") == stores.tenants(F.lit(customer_id))) & (F.col("customerId") == F.lit(customer_id))
    outside = read_table(spark, stores, "versions").where(mine & ~F.col("timestamp").between(low, high))
    newer = outside.groupBy(F.col("eventId").alias("_id")).agg(F.max(order).alias("_later"))
    replaced = (F.col("eventId") == F.col("_id")) & (F.col("_later") > F.col("_order"))
    return latest.join(newer, replaced, "left_anti").select(*EVENT_COLUMNS, "event_time")


def write_metadata(events: DataFrame, stores: Stores, batch_id: int) -> None:
    """Insert ids that are not stored yet; refuse rows that break a constraint.

    New ids are claimed in the id index first, which reads the buckets of the
    batch's own ids; then their first rows are stored. A replay does not meet
    itself and decides as before. Every stored id counts.
    """
    spark = events.sparkSession
    rows, refused = split_rows(to_metadata(_with_seq(events), "seq"))
    index = stores.ids()
    claimed = index.claim(rows.select("event_id", "occurred_at"), stores.writer, batch_id)
    fresh = first_per_key(rows, ["event_id"], F.col("seq")).join(claimed, "event_id", "left_semi")
    dated = fresh.withColumn("event_date", stores.event_date("occurred_at"))
    _write(dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "occurred_at"), stores, "metadata", batch_id)
    _write(refused.hint("rebalance"), stores, "violations", batch_id)
    index.compact(spark)


def topic_records(events: DataFrame) -> DataFrame:
    """Events as keyed records; the tenant is the key."""
    extra = ["seq"] if "seq" in events.columns else []
    return events.select(F.col("customerId").alias("key"), event_json().alias("value"), *extra)


def in_tenant_order(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Place events so that reading the files in order keeps each tenant's order.

    Ranges over (tenant, seq) instead of a hash of the tenant: a dominant tenant
    is cut into consecutive ranges and never forced into one task.  Without a
    number the shuffle setting decides, and adaptive execution merges ranges.
    """
    order = ("customerId", "seq")
    ranges = (partitions, *order) if partitions else order
    return events.repartitionByRange(*ranges).sortWithinPartitions(*order)


def write_enriched(events: DataFrame, stores: Stores, batch_id: int) -> None:
    """Publish enriched events for alerting; replays publish again.

    The JSON is made after the placing, which samples its input first.
    """
    _write(topic_records(in_tenant_order(_with_seq(events))), stores, "enriched", batch_id)


def write_kafka(records: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Publish keyed records to a topic and fail unless all are acknowledged."""
    settings = {
        "kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all",
        "kafka.enable.idempotence": "true", **options,
    }
    records.select("key", "value").write.format("kafka").options(**settings).save()


def write_alerts(events: DataFrame, rules: DataFrame | PreparedRules, stores: Stores, batch_id: int, **build) -> None:
    """Fill the outbox.  Two deliveries of an event alert twice, a replay does not."""
    # few alerts per task: merged into full files, split where one is large
    _write(build_alerts(events, rules, **build).hint("rebalance"), stores, "alerts", batch_id)


def write_quarantine(records: DataFrame, stores: Stores, batch_id: int) -> None:
    _write(_with_seq(records).hint("rebalance"), stores, "quarantine", batch_id)


@dataclass(frozen=True)
class Sink:
    """A named writer called as ``write(events, batch_id)``.

    One that gives rows back has stored the batch as a whole; the sinks after
    it are fed from there.
    """

    name: str
    write: Callable[[DataFrame, int], DataFrame | None]


def default_sinks(stores: Stores, rules: DataFrame | PreparedRules | None = None) -> list[Sink]:
    """Persist first, page last: evidence, metadata, enriched, then alerts."""
    sinks = [
        Sink("evidence", lambda df, b: write_evidence(df, stores, b)),
        Sink("metadata", lambda df, b: write_metadata(df, stores, b)),
        Sink("enriched", lambda df, b: write_enriched(df, stores, b)),
    ]
    if rules is not None:
        sinks.append(Sink("alerts", lambda df, b: write_alerts(df, rules, stores, b)))
    return sinks


def fan_out(events: DataFrame, sinks: list[Sink], batch_id: int) -> None:
    """Give one batch to every sink in turn.

    A failing sink fails the batch, and the replay overwrites what the earlier
    sinks wrote.  Nothing is kept in memory: once evidence is written, the other
    sinks read its files, so a batch is computed once and a lost executor costs
    no more than its own tasks.
    """
    for sink in sinks:
        stored = sink.write(events, batch_id)
        events = events if stored is None else stored


def fan_out_decoded(
    decoded: DataFrame,
    stores: Stores,
    sinks: list[Sink],
    batch_id: int,
    steps: list[Step] | None = None,
) -> None:
    """Enrich decoded records and fan them out; set the undecodable ones aside.

    Bad records are counted while the first sink stores the good ones, and only
    a batch that has any is decoded again to write them.
    """
    failed = F.col("decode_error").isNotNull()
    seen = Observation()
    watched = enrich(decoded, steps).observe(seen, F.count_if(failed).alias("bad"))
    good = watched.where(~failed).drop("decode_error", "key", "value")
    if not sinks:
        return write_quarantine(decoded.where(failed).select("key", "value", "seq", "decode_error"), stores, batch_id)
    stored = sinks[0].write(good, batch_id)
    if _any(seen, "bad"):
        write_quarantine(decoded.where(failed).select("key", "value", "seq", "decode_error"), stores, batch_id)
    fan_out(good if stored is None else stored, sinks[1:], batch_id)


__all__ = [
    "Sink", "Stores", "default_sinks", "fan_out", "fan_out_decoded", "in_tenant_order", "read_evidence",
    "read_evidence_window", "read_table", "topic_records", "write_alerts", "write_enriched",
    "write_evidence", "write_kafka", "write_metadata", "write_quarantine",
]
