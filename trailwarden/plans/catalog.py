"""The query catalog: every operator over the given test tables.

Results are scalar columns (instants as ISO text, nested values as JSON or
joined text) so that they compare with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.functions import text
from trailwarden.functions.text import iso_instant
from trailwarden.operators import enrich as en
from trailwarden.operators import evidence as ev
from trailwarden.operators import keyed, matching, reports, retention, validation
from trailwarden.operators.conditions import TOO_LONG
from trailwarden.plans import fixtures as fx
from trailwarden.plans.jobs import log_metadata, store_records
from trailwarden.session import new_workdir, use_utc
from trailwarden.sinks.tables import (
    Stores,
    default_sinks,
    fan_out,
    in_tenant_order,
    read_evidence,
    read_evidence_window,
    read_table,
    topic_records as to_records,
    write_evidence,
    write_metadata,
)
from trailwarden.sinks.compaction import compact_table
from trailwarden.sinks.purge import purge_metadata, surviving
from trailwarden.sources import collectors, events as event_source, querylog
from trailwarden.sources.marks import Marks, log_collector
from trailwarden.sources.rules import load_rules
from trailwarden.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return build(spark, sf_dir)

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


_FLAT = {
    "eventId": "event_id", "customerId": "customer_id", "userId": "user_id", "sessionId": "session_id",
    "timestamp": "ts", "type": "type", "resource": "resource", "action": "action", "query": "query",
    "ipAddress": "ip_address", "riskLevel": "risk_level", "anomalous": "anomalous",
}


def _controls() -> Column:
    parts = F.transform("controls", lambda c: F.concat_ws("/", c["controlId"], c["framework"], c["name"]))
    return F.array_join(parts, ";").alias("controls")


def _flat(events: DataFrame, *names: str) -> DataFrame:
    """Scalar view of events; ``names`` (default all) are event column names."""
    columns = []
    for name in names or (*_FLAT, "controls", "tags"):
        if name == "controls":
            columns.append(_controls())
        elif name == "tags":
            columns.append(F.to_json("tags").alias("tags"))
        elif name == "timestamp":
            columns.append(iso_instant(F.col(name)).alias("ts"))
        else:
            columns.append(F.col(name).alias(_FLAT.get(name, name)))
    return events.select(*columns)


def _flat_metadata(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "customer_id", "user_id", "session_id",
        iso_instant(F.col("occurred_at")).alias("occurred_at"),
        "event_type", "resource", "action", "risk_level", "anomalous",
    )


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.enrich(fx.audit_events(spark, sf_dir))


def _replayed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata after every delivery: first write per id."""
    rows = ev.to_metadata(en.detect_anomalies(fx.replayed_events(spark, sf_dir)), "seq")
    return keyed.first_per_key(rows, ["event_id"], F.col("seq"))


# -- ingestion ---------------------------------------------------------------
def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.normalize_requests(fx.requests(spark, sf_dir), ev.instant(fx.INGEST_TS))


@query
def ingest_requests(spark, sf_dir):
    good = validation.accepted(_checked(spark, sf_dir))
    return _flat(good, "seq", "eventId", "customerId", "type", "resource", "timestamp", "riskLevel", "anomalous", "controls", "tags")


@query
def ingest_rejects(spark, sf_dir):
    bad = validation.rejected(_checked(spark, sf_dir))
    return bad.select("seq", F.col("eventId").alias("event_id"), "reject_reason")


@query
def parse_events(spark, sf_dir):
    return _flat(event_source.decoded(fx.poisoned_records(spark, sf_dir)))


@query
def corrupt_records(spark, sf_dir):
    bad = event_source.quarantined(fx.poisoned_records(spark, sf_dir))
    return bad.select("seq", "key", "value", "decode_error")


@query
def topic_records(spark, sf_dir):
    return to_records(in_tenant_order(fx.audit_events(spark, sf_dir))).select("seq", "key", "value")


# -- enrichment --------------------------------------------------------------
@query
def enrich_user_context(spark, sf_dir):
    return _flat(en.add_user_context(fx.audit_events(spark, sf_dir)), "eventId", "userId", "tags")


@query
def enrich_controls(spark, sf_dir):
    """The lookup as a join with a control table."""
    classified = en.classify_controls(fx.audit_events(spark, sf_dir), en.default_controls(spark))
    return _flat(classified, "eventId", "type", "controls")


@query
def enrich_anomaly(spark, sf_dir):
    return _flat(en.detect_anomalies(fx.audit_events(spark, sf_dir)), "eventId", "type", "riskLevel", "anomalous")


@query
def enrich_all(spark, sf_dir):
    return _flat(_enriched(spark, sf_dir))


@query
def enriched_records(spark, sf_dir):
    return to_records(_enriched(spark, sf_dir)).select("seq", "key", "value")


# -- rules and alerts --------------------------------------------------------
@query
def rules_load(spark, sf_dir):
    location = new_workdir(spark, "rules")
    documents = (
        fx.rule_rows(spark, sf_dir)
        .groupBy("document")  # a few thousand rules each
        .agg(F.to_json(F.collect_list(F.struct(*fx.RULE_FIELDS))).alias("value"))
    )
    documents.select("value").write.option("maxRecordsPerFile", 1).text(location)
    return matching.rules_by_customer(load_rules(spark, location)).withColumnRenamed("customerId", "customer_id")


@query
def rule_matches(spark, sf_dir):
    return matching.match_rules(_enriched(spark, sf_dir), fx.rules(spark)).select(
        F.col("ruleId").alias("rule_id"), F.col("eventId").alias("event_id"), F.col("riskLevel").alias("risk_level")
    )


@query
def rule_conditions(spark, sf_dir):
    return matching.match_conditions(_enriched(spark, sf_dir), fx.rules(spark)).select(
        F.col("ruleId").alias("rule_id"), F.col("eventId").alias("event_id")
    )


@query
def rule_errors(spark, sf_dir):
    """Enabled rules whose condition is refused: broken ones and over-long ones."""
    return matching.rejected_rules(fx.odd_rules(spark, sf_dir)).select(
        F.col("ruleId").alias("rule_id"), (F.col("error") == TOO_LONG).alias("too_long"))


@query
def rule_matches_many(spark, sf_dir):
    """A rule with a condition of its own for each customer, in one join."""
    return matching.match_rules(_enriched(spark, sf_dir), fx.rule_per_user(spark, sf_dir)).select(
        F.col("ruleId").alias("rule_id"), F.col("eventId").alias("event_id"))


@query
def alert_dispatch(spark, sf_dir):
    counts = matching.dispatch_counts(_enriched(spark, sf_dir), fx.rules(spark))
    return counts.select(F.col("customerId").alias("customer_id"), F.col("eventId").alias("event_id"), "fired")


@query
def alert_unknown_channels(spark, sf_dir):
    rows = matching.explode_channels(matching.match_rules(_enriched(spark, sf_dir), fx.rules(spark)))
    return matching.undeliverable(rows).select(
        F.col("ruleId").alias("rule_id"), F.col("eventId").alias("event_id"), "channel"
    )


def _flat_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "alert_id", "rule_id", "event_id", "customer_id",
        iso_instant(F.col("triggered_at")).alias("triggered_at"),
        "channel", "channel_pos", "subject", "body", "payload", "status",
    )


@query
def alert_messages(spark, sf_dir):
    return _flat_alerts(matching.build_alerts(_enriched(spark, sf_dir), fx.rules(spark)))


@query
def alerts_end_to_end(spark, sf_dir):
    """Raw JSON records to per-channel outbox rows."""
    events = en.enrich(event_source.decoded(fx.raw_records(spark, sf_dir)))
    return matching.build_alerts(events, fx.rules(spark)).select(
        "alert_id", "rule_id", "event_id", "customer_id", "channel", "channel_pos", "subject"
    )


# -- stores ------------------------------------------------------------------
@query
def evidence_latest(spark, sf_dir):
    latest = ev.latest_evidence(en.enrich(fx.replayed_events(spark, sf_dir)), F.col("seq"))
    return ev.evidence_documents(latest, "seq")


@query
def metadata_insert(spark, sf_dir):
    """A second delivery round against a table that already holds some ids."""
    rows = ev.to_metadata(en.detect_anomalies(fx.replayed_events(spark, sf_dir)), "seq")
    stored = rows.where((F.col("event_type") == "AUTH_EVENT") & (F.col("customer_id") != "cust-x"))
    return _flat_metadata(keyed.insert_if_absent(rows, stored, "event_id", F.col("seq")))


@query
def metadata_violations(spark, sf_dir):
    events = validation.normalize_requests(fx.requests(spark, sf_dir), ev.instant(fx.INGEST_TS))
    _, refused = validation.split_rows(ev.to_metadata(validation.accepted(events), "seq"))
    return refused.select("seq", "event_id", "violated")


@query
def pk_duplicates(spark, sf_dir):
    rows = fx.replayed_events(spark, sf_dir).select(F.col("eventId").alias("event_id"))
    return validation.duplicate_keys(rows, "audit_events")


@query
def fk_orphans(spark, sf_dir):
    child = fx.users(spark, sf_dir)
    return validation.orphans(child, fx.customers(spark, sf_dir), "users").select("user_id", "customer_id")


@query
def fanout_counts(spark, sf_dir):
    """Rows in each store after one batch through every sink."""
    stores = Stores(new_workdir(spark, "fanout"))
    events = en.enrich(fx.replayed_events(spark, sf_dir))
    fan_out(events, default_sinks(stores, fx.rules(spark)), 0)
    tables = ["metadata", "enriched", "alerts", "violations"]
    counts = [read_table(spark, stores, t).agg(F.count("*").alias("rows")).withColumn("sink", F.lit(t)) for t in tables]
    total = read_evidence(spark, stores).agg(F.count("*").alias("rows")).withColumn("sink", F.lit("evidence"))
    for part in counts:
        total = total.unionByName(part)
    return total.select("sink", "rows")


# -- evidence and reports ----------------------------------------------------
def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evidence_window(_enriched(spark, sf_dir), fx.REPORT_TENANT, fx.REPORT_FROM, fx.REPORT_TO)


def _flat_window(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("eventId").alias("event_id"),
        F.col("customerId").alias("customer_id"),
        iso_instant(F.col("event_time")).alias("event_time"),
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_second"),
        "type", "resource", "action", F.col("riskLevel").alias("risk_level"), "anomalous", _controls(),
    )


@query
def evidence_query(spark, sf_dir):
    return _flat_window(ev.evidence_query(_enriched(spark, sf_dir), fx.REPORT_TENANT, fx.REPORT_FROM, fx.REPORT_TO))


@query
def evidence_store_window(spark, sf_dir):
    """The same from a store in which later versions moved events into the window and out of it."""
    stores = Stores(new_workdir(spark, "window"))
    write_evidence(_enriched(spark, sf_dir), stores, 0)
    write_evidence(fx.moved(_enriched(spark, sf_dir)), stores, 1)
    return _flat_window(read_evidence_window(spark, stores, fx.REPORT_TENANT, fx.REPORT_FROM, fx.REPORT_TO))


def _report(spark, sf_dir, framework):
    lines = reports.report_lines(_window(spark, sf_dir), framework)
    return lines.select(
        "framework", F.col("eventId").alias("event_id"), iso_instant(F.col("event_time")).alias("event_time"), "line"
    )


@query
def report_soc2(spark, sf_dir):
    return _report(spark, sf_dir, "SOC2")


@query
def report_gdpr(spark, sf_dir):
    return _report(spark, sf_dir, "GDPR")


@query
def report_hipaa(spark, sf_dir):
    return _report(spark, sf_dir, "HIPAA")


@query
def report_all_events(spark, sf_dir):
    """The bare framework filter: without a window all tenants' events are lines."""
    lines = reports.framework_lines(_enriched(spark, sf_dir))
    return lines.select("framework", F.col("eventId").alias("event_id"), "line")


@query
def report_own_controls(spark, sf_dir):
    """Lines under a control table that adds a framework the built-in map has no controls of."""
    events = en.classify_controls(fx.audit_events(spark, sf_dir), fx.more_controls(spark))
    lines = reports.framework_lines(events)
    return lines.select("framework", F.col("eventId").alias("event_id"), "line")


@query
def report_summary(spark, sf_dir):
    return reports.report_summary(_window(spark, sf_dir))


@query
def report_text(spark, sf_dir):
    document = reports.report_documents(_window(spark, sf_dir), fx.REPORT_TENANT, fx.REPORT_FROM, fx.REPORT_TO)
    return document.orderBy("framework", "part", "event_time", "eventId").select(
        "framework", "part", F.col("eventId").alias("event_id"), iso_instant(F.col("event_time")).alias("event_time"), "line"
    )


# -- query log ---------------------------------------------------------------
@query
def log_collect(spark, sf_dir):
    rows = querylog.collect_batch(fx.general_log(spark, sf_dir), fx.LOG_SINCE, fx.LOG_BATCH)
    return rows.select(
        "seq", iso_instant(F.col("event_time")).alias("event_time"), "user_host", "thread_id", "command_type", "argument"
    )


@query
def log_checkpoint(spark, sf_dir):
    marks = querylog.checkpoints(fx.general_log(spark, sf_dir), fx.LOG_SINCE, fx.LOG_BATCH)
    return marks.select(
        "rows_read", iso_instant(F.col("mark")).alias("mark"), iso_instant(F.col("log_maximum")).alias("log_maximum")
    )


@query
def log_noise(spark, sf_dir):
    return querylog.with_noise(fx.general_log(spark, sf_dir)).select("seq", "statement", "noise")


def _log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.log_events(fx.general_log(spark, sf_dir), fx.LOG_TENANT, fx.LOG_RESOURCE)


_LOG_COLUMNS = ("seq", "eventId", "customerId", "userId", "timestamp", "type", "resource", "action", "query")


@query
def log_events(spark, sf_dir):
    return _flat(_log_events(spark, sf_dir), *_LOG_COLUMNS)


@query
def redact_sql(spark, sf_dir):
    log = fx.general_log(spark, sf_dir)
    return log.select("seq", text.redact_sql(F.col("argument")).alias("redacted"))


@query
def agent_forward(spark, sf_dir):
    forwarded = querylog.wire_requests(_log_events(spark, sf_dir))
    arrived = validation.normalize_requests(forwarded, ev.instant(fx.INGEST_TS))
    return _flat(validation.accepted(arrived), *_LOG_COLUMNS, "riskLevel")


def _collectors(spark: SparkSession, sf_dir: str) -> list[collectors.Collector]:
    crm = querylog.log_events(fx.crm_log(spark, sf_dir), fx.LOG_TENANT, fx.WEB_RESOURCE)
    return [
        collectors.Collector(querylog.source_name(fx.LOG_RESOURCE), lambda: _log_events(spark, sf_dir)),
        collectors.Collector(querylog.source_name(fx.WEB_RESOURCE), lambda: crm),
    ]


@query
def collect_all(spark, sf_dir):
    gathered = collectors.collect_all(_collectors(spark, sf_dir))
    arrived = validation.normalize_requests(gathered, ev.instant(fx.INGEST_TS))
    return arrived.groupBy("source").agg(
        F.count("*").alias("collected"), F.count_if(F.col("reject_reason").isNull()).alias("delivered")
    )


@query
def log_replay_dedupe(spark, sf_dir):
    """Two overlapping polls; rows read twice collapse on their id."""
    events = _log_events(spark, sf_dir)
    first = events.where(F.col("timestamp") <= ev.instant("1997-12-31T00:00:00Z"))
    second = events.where(F.col("timestamp") >= ev.instant("1996-01-01T00:00:00Z"))
    unique = keyed.collapse_replays(first.unionByName(second).drop("seq"), "eventId")
    return _flat(unique, "eventId", "userId", "timestamp", "action", "query")


@query
def log_polls(spark, sf_dir):
    """Three polls from a stored mark, one of them lost after delivery and repeated by a new collector."""
    stores = Stores(new_workdir(spark, "polls"), period="year", writer="general-log")
    marks, log = Marks(stores.path("marks")), fx.general_log(spark, sf_dir)
    for attempt in range(4):
        def deliver(events, attempt=attempt):
            write_metadata(en.enrich(events), stores, attempt)
            if attempt == 1:
                raise RuntimeError("stored, but the answer got lost")

        source = log_collector(log, marks, fx.LOG_TENANT, fx.LOG_RESOURCE, fx.LOG_SINCE, fx.LOG_BATCH)
        collectors.poll([source], deliver)
    mark = marks.current(spark, querylog.source_name(fx.LOG_RESOURCE))
    return _flat_metadata(read_table(spark, stores, "metadata")).withColumns(
        {"mark": iso_instant(F.lit(mark.at)), "moves": F.lit(mark.version)})


@query
def log_to_metadata(spark, sf_dir):
    return _flat_metadata(log_metadata(fx.general_log(spark, sf_dir), fx.LOG_TENANT, fx.LOG_RESOURCE))


# -- retention ---------------------------------------------------------------
@query
def retention_expired(spark, sf_dir):
    rows = retention.expired(_replayed_metadata(spark, sf_dir), fx.RETENTION_NOW, fx.RETENTION_DAYS)
    return _flat_metadata(rows).select("event_id", "customer_id", "occurred_at", "event_type")


@query
def retention_kept(spark, sf_dir):
    return _flat_metadata(retention.kept(_replayed_metadata(spark, sf_dir), fx.RETENTION_NOW, fx.RETENTION_DAYS))


@query
def retention_one_statement(spark, sf_dir):
    rows = retention.after_one_statement(
        _replayed_metadata(spark, sf_dir), fx.RETENTION_NOW, fx.RETENTION_DAYS, fx.RETENTION_BATCH
    )
    return _flat_metadata(rows).select("event_id", "customer_id", "occurred_at")


@query
def retention_summary(spark, sf_dir):
    return retention.purge_summary(
        _replayed_metadata(spark, sf_dir), fx.RETENTION_NOW, fx.RETENTION_DAYS, fx.RETENTION_BATCH
    )


@query
def retention_batches(spark, sf_dir):
    rows = retention.purge_batches(
        _replayed_metadata(spark, sf_dir), fx.RETENTION_NOW, fx.RETENTION_DAYS, fx.RETENTION_BATCH
    )
    return rows.select("event_id", iso_instant(F.col("occurred_at")).alias("occurred_at"), "row_index", "batch")


@query
def purge_store(spark, sf_dir):
    """What a purge leaves of a stored table: whole folders go, the boundary is rewritten."""
    stores = Stores(new_workdir(spark, "purge"))
    write_metadata(fx.replayed_events(spark, sf_dir).transform(en.detect_anomalies), stores, 0)
    purge_metadata(spark, stores, fx.RETENTION_NOW, fx.RETENTION_DAYS, fx.RETENTION_BATCH)
    return _flat_metadata(surviving(spark, stores))


# -- text --------------------------------------------------------------------
@query
def iso_instants(spark, sf_dir):
    ts = F.col("timestamp")
    return fx.audit_events(spark, sf_dir).select(
        "seq",
        iso_instant(ts).alias("micros"),
        iso_instant(F.date_trunc("millisecond", ts)).alias("millis"),
        iso_instant(F.date_trunc("second", ts)).alias("seconds"),
    )


# -- streaming ---------------------------------------------------------------
def _finish(stream_query) -> None:
    stream_query.awaitTermination()


def _checkpoint(stores: Stores) -> str:
    return f"{stores.root}/_checkpoints"


@query
def stream_enrich(spark, sf_dir):
    """Stream the raw records through enrichment into the stores; read evidence."""
    stores = Stores(new_workdir(spark, "stream-enrich"))
    records = fx.raw_records(spark, sf_dir, streaming=True)
    _finish(streams.enrichment_stream(records, stores, _checkpoint(stores)))
    return _flat(read_evidence(spark, stores))


@query
def stream_alerts(spark, sf_dir):
    """Stream enriched records against the rules; read the outbox."""
    stores = Stores(new_workdir(spark, "stream-alerts"))
    events = en.enrich(fx.audit_events(spark, sf_dir, streaming=True))
    _finish(streams.alert_stream(to_records(events), fx.rules(spark), stores, _checkpoint(stores)))
    return _flat_alerts(read_table(spark, stores, "alerts"))


@query
def stream_log_collect(spark, sf_dir):
    """Stream the query log into evidence and metadata; read the metadata."""
    stores = Stores(new_workdir(spark, "stream-log"), period="year")
    into = streams.into_sinks(default_sinks(stores.of("general-log"))[:2])
    log = fx.general_log(spark, sf_dir, streaming=True)
    _finish(streams.log_stream(log, fx.LOG_TENANT, fx.LOG_RESOURCE, lambda b, n: into(en.enrich(b), n), _checkpoint(stores)))
    return _flat_metadata(read_table(spark, stores, "metadata"))


@query
def stores_two_writers(spark, sf_dir):
    """Pushed records and a query log into one store, both replayed, and two loads on top: rows per event and store."""
    stores = Stores(new_workdir(spark, "two-writers"), period="year")
    into = streams.into_sinks(default_sinks(stores.of("general-log"))[:2])
    for attempt in ("first", "replay"):  # the replay starts from a lost checkpoint
        records = fx.raw_records(spark, sf_dir, streaming=True)
        _finish(streams.enrichment_stream(records, stores, f"{_checkpoint(stores)}/push-{attempt}"))
        log = fx.general_log(spark, sf_dir, streaming=True)
        _finish(streams.log_stream(
            log, fx.LOG_TENANT, fx.LOG_RESOURCE, lambda b, n: into(en.enrich(b), n), f"{_checkpoint(stores)}/log-{attempt}"))
    for _ in range(2):
        store_records(fx.raw_records(spark, sf_dir), stores)
    held = read_table(spark, stores, "metadata").groupBy("event_id").agg(F.count("*").alias("metadata_rows"))
    seen = read_evidence(spark, stores).groupBy(F.col("eventId").alias("event_id")).agg(F.count("*").alias("evidence_rows"))
    return held.join(seen, "event_id", "full")


@query
def stream_ingest(spark, sf_dir):
    """Stream landed requests into the raw topic; decode what arrived there."""
    stores = Stores(new_workdir(spark, "stream-ingest"))
    requests = fx.requests(spark, sf_dir, streaming=True)
    _finish(streams.ingest_stream(requests, lambda: ev.instant(fx.INGEST_TS), stores, _checkpoint(stores)))
    arrived = event_source.decoded(spark.read.parquet(stores.path("raw")))
    return _flat(arrived, "eventId", "customerId", "type", "resource", "timestamp", "riskLevel", "anomalous")


@query
def agent_to_raw(spark, sf_dir):
    """A query log forwarded as JSON files in two batches, replayed from a lost checkpoint, and ingested."""
    stores = Stores(new_workdir(spark, "agent"))
    landing = stores.path("landing")
    fx.general_log(spark, sf_dir).repartition(2, "seq").drop("seq").write.parquet(stores.path("log"))
    for attempt in ("first", "replay"):
        log = querylog.file_log(spark, stores.path("log"), streaming=True, max_files=1)
        _finish(streams.forward_stream(log, fx.LOG_TENANT, fx.LOG_RESOURCE, landing, f"{_checkpoint(stores)}/{attempt}"))
        requests = event_source.request_files(spark, f"{landing}/*", streaming=True)
        _finish(streams.ingest_stream(requests, lambda: ev.instant(fx.INGEST_TS), stores, f"{_checkpoint(stores)}/ingest"))
    arrived = event_source.decoded(event_source.file_records(spark, stores.path("raw")))
    return _flat(arrived, *_LOG_COLUMNS[1:], "riskLevel")


@query
def stream_dedupe_recent(spark, sf_dir):
    """Stream replayed deliveries through the bounded-state duplicate filter."""
    stores = Stores(new_workdir(spark, "stream-recent"))
    unique = streams.recent_unique(fx.replayed_events(spark, sf_dir, streaming=True), "30 days")

    def keep(batch, batch_id):
        batch.select("event_id").write.mode("overwrite").parquet(f"{stores.path('recent')}/batch_id={batch_id}")

    _finish(streams.run_batches(unique, keep, _checkpoint(stores)))
    return spark.read.parquet(stores.path("recent")).select("event_id")


@query
def stream_dedupe(spark, sf_dir):
    """Stream replayed deliveries into the insert-if-absent store."""
    stores = Stores(new_workdir(spark, "stream-dedupe"))
    events = en.detect_anomalies(fx.replayed_events(spark, sf_dir, streaming=True))
    _finish(streams.metadata_stream(events, stores, _checkpoint(stores)))
    return _flat_metadata(read_table(spark, stores, "metadata"))



@query
def stream_insert_many(spark, sf_dir):
    """Five micro-batches whose ids repeat across batches, the last two after a restart."""
    stores = Stores(new_workdir(spark, "insert-many"))
    files = 0
    for k in range(5):
        fx.delivery(spark, sf_dir, k).write.mode("append").parquet(stores.path("deliveries"))
        landed = spark.read.parquet(stores.path("deliveries"))
        files = files or len(landed.inputFiles())  # of one delivery, from as many tasks as read the table
        if k >= 2:  # the first three are there when the stream first starts
            events = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files).parquet(stores.path("deliveries"))
            _finish(streams.metadata_stream(en.detect_anomalies(events), stores, _checkpoint(stores)))
    return _flat_metadata(read_table(spark, stores, "metadata"))


@query
def compacted_store(spark, sf_dir):
    """Five batches, merged on the way and at the end, with replays of merged batches: stored rows per event."""
    stores = Stores(new_workdir(spark, "compacted"), period="month", buckets=4)
    tables = ("evidence", "versions", "metadata")

    def deliver(*batches):
        for k in batches:
            fan_out(en.detect_anomalies(fx.delivery(spark, sf_dir, k)), default_sinks(stores)[:2], k)

    deliver(0, 1, 2)
    for table in tables:
        compact_table(spark, stores, table, least=2)
    deliver(1, 3, 4)  # the second batch again, after it was merged
    for table in tables:
        compact_table(spark, stores, table, least=2)
    deliver(0)
    event_id = F.col("eventId").alias("event_id")
    rows = [
        read_table(spark, stores, "evidence").select(event_id, F.lit("evidence_rows").alias("store")),
        read_table(spark, stores, "versions").select(event_id, F.lit("version_rows").alias("store")),
        read_table(spark, stores, "metadata").select("event_id", F.lit("metadata_rows").alias("store")),
    ]
    count = lambda name: F.count_if(F.col("store") == name).alias(name)
    stored = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return stored.groupBy("event_id").agg(count("evidence_rows"), count("version_rows"), count("metadata_rows"))
