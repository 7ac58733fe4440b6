"""Stores under replays, collisions, purges and streams."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from conftest import AT

from trailwarden.operators.enrich import enrich
from trailwarden.sinks import tables as tb
from trailwarden.sinks.purge import purge_metadata, surviving
from trailwarden.sources.events import file_records
from trailwarden.streaming import jobs


def with_seq(df, start=0):
    return df.withColumn("seq", F.monotonically_increasing_id() + start)


def contents(spark, stores, table, *columns):
    return sorted(tuple(r) for r in tb.read_table(spark, stores, table).select(*columns).collect())


def test_replays_and_collisions(spark, events_of, rules_of, tmp_path):
    stores = tb.Stores(str(tmp_path))
    sinks = tb.default_sinks(stores, rules_of({"customerId": "cust-1"}))
    first = with_seq(enrich(events_of({"eventId": "a"}, {"eventId": "b", "riskLevel": "HIGH"})))
    second = with_seq(
        enrich(
            events_of(
                {"eventId": "a", "customerId": "other"}, {"eventId": "b", "riskLevel": "CRITICAL"}, {"eventId": "c"},
                {"eventId": "d", "resource": "r" * 600},
            )
        )
    )
    tb.fan_out(first, sinks, 0)
    for _ in range(2):  # the second time is a replay after a lost acknowledgement
        tb.fan_out(second, sinks, 1)
        assert contents(spark, stores, "metadata", "event_id", "customer_id", "risk_level") == [
            ("a", "cust-1", "LOW"), ("b", "cust-1", "HIGH"), ("c", "cust-1", "LOW"),
        ]
        assert contents(spark, stores, "violations", "event_id", "violated") == [("d", "resource")]
        latest = {(r.customerId, r.eventId): r.riskLevel for r in tb.read_evidence(spark, stores).collect()}
        assert latest[("cust-1", "b")] == "CRITICAL" and len(latest) == 5
        assert tb.read_table(spark, stores, "enriched").count() == 6
        assert len(contents(spark, stores, "alerts", "event_id")) == 5


def test_writers_of_one_store_do_not_meet(spark, events_of, tmp_path):
    stores = tb.Stores(str(tmp_path))
    for writer, event in (("a", "e1"), ("b", "e2"), ("a", "e1"), ("c", "e2")):
        tb.fan_out(with_seq(enrich(events_of({"eventId": event, "action": writer}))), tb.default_sinks(stores.of(writer)), 7)
    assert contents(spark, stores, "metadata", "event_id", "action") == [("e1", "a"), ("e2", "b")]
    assert {(r.eventId, r.action) for r in tb.read_evidence(spark, stores).collect()} == {("e1", "a"), ("e2", "c")}
    with pytest.raises(ValueError):
        stores.of("a/b")


def test_a_failing_sink_leaves_a_replayable_batch(spark, events_of, tmp_path):
    stores = tb.Stores(str(tmp_path))
    order, broken = [], [True]

    def flaky(df, batch_id):
        order.append("flaky")
        if broken[0]:
            raise RuntimeError("not acknowledged")

    sinks = [*tb.default_sinks(stores)[:1], tb.Sink("flaky", flaky), tb.Sink("last", lambda *a: order.append("last"))]
    events = with_seq(events_of({}, {}))
    with pytest.raises(RuntimeError):
        tb.fan_out(events, sinks, 0)
    broken[0] = False
    tb.fan_out(events, sinks, 0)
    assert order == ["flaky", "flaky", "last"]
    assert tb.read_table(spark, stores, "evidence").count() == 2


def test_window_uses_the_latest_version_wherever_it_is(spark, events_of, tmp_path):
    stores = tb.Stores(str(tmp_path))
    day = timedelta(days=1)
    tb.write_evidence(with_seq(events_of({"eventId": "in"}, {"eventId": "moved"}, {"eventId": "back", "timestamp": AT - 9 * day})), stores, 0)
    moved = events_of(
        {"eventId": "moved", "timestamp": AT + 9 * day}, {"eventId": "back"}, {"eventId": "in", "customerId": "x"},
    )
    tb.write_evidence(with_seq(moved), stores, 1)
    got = tb.read_evidence_window(spark, stores, "cust-1", AT - day, AT + day)
    assert {r.eventId for r in got.collect()} == {"in", "back"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(customerId,cust-1)" in plan


def test_records_to_stores_to_report(spark, events_of, rules_of, tmp_path):
    from trailwarden.plans.jobs import alerts_for, framework_report, store_records, write_report

    stores = tb.Stores(str(tmp_path / "stores"), "month")
    events = events_of(
        {"type": "DATA_EXPORT"}, {"type": "AUTH_EVENT", "riskLevel": None}, {"type": "API_CALL", "customerId": "x"},
        {"type": "AUTH_EVENT", "timestamp": AT + timedelta(days=60)},
    )
    records = tb.topic_records(with_seq(events))
    rules = rules_of({"customerId": "cust-1", "conditionExpression": "anomalous"})
    store_records(records, stores, rules)
    assert contents(spark, stores, "alerts", "event_id") == [("evt-0",)]
    assert [r.event_id for r in alerts_for(records, rules).collect()] == ["evt-0"]
    reports = {
        framework: [r.value for r in framework_report(spark, stores, framework, "cust-1", AT, AT + timedelta(days=1)).collect()]
        for framework in ("SOC2", "GDPR", "HIPAA")
    }
    assert reports["SOC2"][3:] == [
        "Events: 2",
        "evt-0 | DATA_EXPORT | controls=AU-2 | risk=HIGH",
        "evt-1 | AUTH_EVENT | controls=AC-2,IA-2 | risk=null",
    ]
    assert reports["GDPR"][4:] == ["evt-0 | DATA_EXPORT | controls=Art-30 | risk=HIGH"]
    assert reports["HIPAA"] == [
        "HIPAA Audit Controls Report", "Customer: cust-1",
        "Period: 2026-01-01T00:00:00Z - 2026-01-02T00:00:00Z", "Events: 0",
    ]
    out = str(tmp_path / "report")
    write_report(framework_report(spark, stores, "GDPR", "cust-1", AT, AT + timedelta(days=1)), out)
    assert spark.read.text(out).count() == 5


@pytest.mark.parametrize("period", ["day", "month"])
def test_purge_drops_folders_and_rewrites_the_boundary(spark, events_of, tmp_path, period):
    stores = tb.Stores(str(tmp_path), period)
    ages = {"old-1": 31, "old-2": 60, "old-3": 90, "edge-old": 30.2, "edge-new": 29.9, "recent-1": 29, "recent-2": 0}
    rows = [{"eventId": k, "timestamp": AT - timedelta(days=d)} for k, d in ages.items()]
    tb.write_metadata(with_seq(events_of(*rows[:4])), stores, 0)
    tb.write_metadata(with_seq(events_of(*rows[4:])), stores, 1)
    assert purge_metadata(spark, stores, AT, days=30, batch=2) == (4, 3)
    assert {r.event_id for r in surviving(spark, stores).collect()} == {"edge-new", "recent-1", "recent-2"}
    assert purge_metadata(spark, stores, AT, days=30, batch=2) == (0, 1)
    assert surviving(spark, stores).count() == 3


def test_topic_files_keep_each_tenants_order(spark, events_of, tmp_path):
    events = with_seq(events_of(*[{"customerId": "big" if i % 3 else "small"} for i in range(300)]).repartition(5))
    placed = tb.topic_records(tb.in_tenant_order(events, 4))
    rows = placed.withColumn("part", F.spark_partition_id()).collect()
    for tenant in ("big", "small"):
        mine = [r.seq for r in rows if r.key == tenant]
        assert mine == sorted(mine) and len(mine) == (200 if tenant == "big" else 100)
    assert len({r.part for r in rows if r.key == "big"}) > 1  # a dominant tenant is split


def test_stream_equals_batch_over_restarts(spark, events_of, rules_of, tmp_path):
    source, stores = str(tmp_path / "topic"), tb.Stores(str(tmp_path / "stores"))
    kinds = ["DATA_EXPORT", "AUTH_EVENT", "API_CALL"]
    events = events_of(*[{"type": kinds[i % 3], "eventId": f"e{i % 8}", "userId": "u"} for i in range(12)])
    records = tb.topic_records(with_seq(events))
    bad = spark.createDataFrame([("cust-1", "not json", 10_000)], "key string, value string, seq bigint")
    records.where("seq % 2 = 0").coalesce(1).write.mode("append").parquet(source)
    rules = rules_of({"customerId": "cust-1", "eventType": "DATA_EXPORT"})

    def run():
        stream = file_records(spark, source, streaming=True, max_files=1)
        jobs.enrichment_stream(stream, stores, str(tmp_path / "checkpoint"), rules).awaitTermination()

    run()
    records.where("seq % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    bad.coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new: nothing changes
    batch = enrich(events)
    assert len(contents(spark, stores, "metadata", "event_id")) == 8
    assert tb.read_table(spark, stores, "enriched").count() == 12
    assert contents(spark, stores, "quarantine", "value", "decode_error") == [("not json", "malformed json")]
    assert len(contents(spark, stores, "alerts", "event_id")) == batch.where("type = 'DATA_EXPORT'").count()
    # the enriched records can be alerted on by a second query
    again = tb.Stores(str(tmp_path / "again"))
    enriched = spark.readStream.schema(tb.table_schema("enriched")).parquet(stores.path("enriched")).drop("batch_id")
    jobs.alert_stream(enriched, rules, again, str(tmp_path / "checkpoint2")).awaitTermination()
    assert contents(spark, again, "alerts", "alert_id") == contents(spark, stores, "alerts", "alert_id")


def test_streams_take_a_table_of_many_files(spark, tmp_path):
    from trailwarden.plans.catalog import all_queries

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert all_queries()["stream_dedupe"](spark, str(tmp_path)).count() == source.count()


def test_ingest_stream(spark, tmp_path):
    from trailwarden.operators.evidence import instant
    from trailwarden.sources.events import decoded, request_files

    landing, stores = tmp_path / "landing", tb.Stores(str(tmp_path / "out"))
    landing.mkdir()
    (landing / "a.json").write_text('{"eventId":"e1","customerId":"c","type":"API_CALL"}\n{"eventId":"e2"}\n')
    stream = request_files(spark, str(landing), streaming=True)
    jobs.ingest_stream(stream, lambda: instant("2026-01-01T00:00:00Z"), stores, str(tmp_path / "cp")).awaitTermination()
    raw = decoded(spark.read.parquet(stores.path("raw")))
    assert [(r.eventId, r.riskLevel) for r in raw.collect()] == [("e1", "LOW")]
    assert [r.reject_reason for r in spark.read.parquet(stores.path("rejects")).collect()] == ["customerId is required"]


def test_order_holds_over_ingest_batches(spark, tmp_path):
    from trailwarden.operators.evidence import instant
    from trailwarden.plans.jobs import store_records
    from trailwarden.sources.events import request_files

    landing, stores = tmp_path / "landing", tb.Stores(str(tmp_path / "out"))
    landing.mkdir()
    for name, action in (("a", "OLD"), ("b", "NEW")):
        (landing / f"{name}.json").write_text(
            f'{{"eventId":"e1","customerId":"c","type":"API_CALL","action":"{action}"}}\nno json {name}\n')
        stream = request_files(spark, str(landing), streaming=True)
        jobs.ingest_stream(stream, lambda: instant("2026-01-01T00:00:00Z"), stores, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.malformed for r in spark.read.parquet(stores.path("rejects")).collect()) == ["no json a", "no json b"]
    store_records(file_records(spark, stores.path("raw")), stores)
    assert [r.action for r in tb.read_evidence(spark, stores).collect()] == ["NEW"]
    assert contents(spark, stores, "metadata", "action") == [("OLD",)]


def test_alert_stream_sets_bad_records_aside(spark, rules_of, tmp_path):
    source, stores = str(tmp_path / "in"), tb.Stores(str(tmp_path / "out"))
    spark.createDataFrame([("c", "not json", 1)], "key string, value string, seq bigint").write.parquet(source)
    jobs.alert_stream(file_records(spark, source, streaming=True), rules_of({}), stores, str(tmp_path / "cp")).awaitTermination()
    assert contents(spark, stores, "quarantine", "value", "decode_error") == [("not json", "malformed json")]
    assert contents(spark, stores, "alerts", "event_id") == []


def test_a_late_first_timer_is_kept(spark, events_of, tmp_path):
    source, seen = str(tmp_path / "events"), []
    for rows in ([{"eventId": "a"}, {"eventId": "b"}], [{"eventId": "a"}, {"eventId": "c", "timestamp": AT - timedelta(days=100)}], [{"eventId": "d"}]):
        events_of(*rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        jobs.run_batches(
            jobs.recent_unique(stream, "1 day"), lambda df, b: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "cp")
        ).awaitTermination()
    assert sorted(seen) == ["a", "b", "c", "d"]


def test_bounded_state_dedupe(spark, events_of, tmp_path):
    source = str(tmp_path / "events")
    events_of({"eventId": "a"}, {"eventId": "a"}, {"eventId": "b"}).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    seen = []
    query = jobs.run_batches(
        jobs.recent_unique(stream, "1 day"), lambda df, b: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "cp")
    )
    query.awaitTermination()
    assert sorted(seen) == ["a", "b"]
