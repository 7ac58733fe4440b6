"""Validation, evidence query, reports, retention, ranking, collectors."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from conftest import AT, one

from trailwarden.operators import evidence as ev
from trailwarden.operators import keyed, reports, retention, validation
from trailwarden.operators.enrich import enrich
from trailwarden.operators.ranking import with_row_index
from trailwarden.plans.jobs import write_report
from trailwarden.sources import collectors, querylog
from trailwarden.sources.events import request_files


def test_requests_are_accepted_or_rejected(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"eventId":"e1","customerId":"c","type":"AUTH_EVENT","action":"LOGIN_FAILURE","riskLevel":"HIGH"}\n'
        '{}\n{"eventId":"e2","customerId":" ","type":"AUTH_EVENT"}\n{"eventId":"e3","customerId":"c"}\n'
        '{"eventId":"e4","customerId":"c","type":"BOGUS"}\n{"eventId":"e5","customerId":"c","type":"API_CALL"}\n'
    )
    requests = request_files(spark, str(tmp_path))
    checked = validation.normalize_requests(requests, ev.instant("2026-01-01T00:00:00Z"))
    good = {r.eventId: r for r in validation.accepted(checked).collect()}
    assert set(good) == {"e1", "e5"}
    assert (good["e1"].riskLevel, good["e1"].timestamp) == ("LOW", datetime(2026, 1, 1))  # the wire has no level
    assert sorted(r.reject_reason for r in validation.rejected(checked).collect()) == [
        "customerId is required", "eventId is required", "invalid type", "type is required",
    ]
    late = validation.normalize_requests(requests, F.lit(None).cast("timestamp"))
    assert validation.accepted(late).count() == 0


def test_metadata_constraints(events_of):
    events = events_of({}, {"resource": "r" * 513}, {"userId": "u" * 65}, {"timestamp": None}, {"resource": "r" * 512})
    good, bad = validation.split_rows(ev.to_metadata(events))
    assert {r.event_id for r in good.collect()} == {"evt-0", "evt-4"}
    assert sorted(r.violated for r in bad.collect()) == ["occurred_at", "resource", "user_id"]


def test_evidence_window(events_of):
    def at(seconds):
        return {"timestamp": AT + timedelta(seconds=seconds)}

    events = events_of(at(-1), at(0), at(9), at(9.5), at(10), at(5) | {"customerId": "other"})
    rows = ev.evidence_query(events, "cust-1", AT, AT + timedelta(seconds=9.9)).collect()
    assert [r.eventId for r in rows] == ["evt-1", "evt-2"]
    assert ev.evidence_query(events, "cust-1' OR '1'='1", AT, AT + timedelta(days=1)).count() == 0
    with pytest.raises(ValueError):
        ev.evidence_query(events, None, AT, AT)


def test_reports(spark, events_of, tmp_path):
    control = lambda c, f: (c, f, "n", None, [], [])
    events = events_of(
        {"controls": [control("AC-2", "SOC2"), control("IA-2", "SOC2"), control("AC-2", "SOC2")], "riskLevel": None},
        {"controls": [control("Art-30", "GDPR")]},
        {"controls": None},
    )
    document = reports.report_document(events, "SOC2", "cust-1", AT, AT + timedelta(days=1))
    lines = [r.value for r in reports.ordered_report(document).collect()]
    assert lines == [
        "SOC 2 Evidence Report", "Customer: cust-1", "Period: 2026-01-01T00:00:00Z - 2026-01-02T00:00:00Z",
        "Events: 1", "evt-0 | DATABASE_QUERY | controls=AC-2,IA-2 | risk=null",
    ]
    write_report(reports.ordered_report(document), str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "\n".join(lines) + "\n"
    counts = {r.framework: r.events for r in reports.report_summary(events).collect()}
    assert counts == {"SOC2": 1, "GDPR": 1, "HIPAA": 0}


def metadata_of(spark, ages):
    rows = [(f"e{i:04d}", AT - timedelta(days=age)) for i, age in enumerate(ages)]
    return spark.createDataFrame(rows, "event_id string, occurred_at timestamp")


def test_retention_window(spark):
    rows = metadata_of(spark, [31, 60, 90, 29, 0, 30])
    assert {r.event_id for r in retention.expired(rows, AT, 30).collect()} == {"e0000", "e0001", "e0002"}
    assert {r.event_id for r in retention.kept(rows, AT, 30).collect()} == {"e0003", "e0004", "e0005"}
    left = retention.after_one_statement(rows, AT, 30, batch=2)
    assert {r.event_id for r in left.collect()} == {"e0000", "e0003", "e0004", "e0005"}
    for bad in ({"days": 0}, {"days": 1, "batch": 0}):
        with pytest.raises(ValueError):
            retention.purge_summary(rows, AT, **bad)


@pytest.mark.parametrize(("rows", "statements"), [(2250, 3), (0, 1), (2000, 3)])
def test_purge_statements(spark, rows, statements):
    summary = one(retention.purge_summary(metadata_of(spark, [50] * rows + [1]), AT, 30, 1000))
    assert (summary.deleted, summary.statements) == (rows, statements)


def test_row_index_equals_sorting(spark):
    rng = random.Random(3)
    data = [(f"id{i:05d}", 7 if i % 3 else rng.randint(0, 50)) for i in range(3000)]  # one value holds most rows
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "id string, v int").repartition(7)
    got = {r.id: r.row_index for r in with_row_index(frame, "v", "id").collect()}
    assert got == {row[0]: i for i, row in enumerate(sorted(data, key=lambda r: (r[1], r[0])))}


def test_first_last_and_absent(spark):
    rows = spark.createDataFrame(
        [("a", "t1", 3), ("a", "t2", 1), ("b", "t1", 2), ("b", "t1", 5)], "id string, tenant string, seq bigint"
    )
    first = keyed.first_per_key(rows, ["id"], F.col("seq"))
    assert {(r.id, r.tenant, r.seq) for r in first.collect()} == {("a", "t2", 1), ("b", "t1", 2)}
    last = keyed.last_per_key(rows, ["tenant", "id"], F.col("seq"))
    assert {(r.id, r.tenant, r.seq) for r in last.collect()} == {("a", "t1", 3), ("a", "t2", 1), ("b", "t1", 5)}
    stored = spark.createDataFrame([("a",), ("z",)], "id string")
    new = keyed.insert_if_absent(rows, stored, "id", F.col("seq"))
    assert [(r.id, r.seq) for r in new.collect()] == [("b", 2)]
    new = keyed.insert_if_absent(rows, None, "id", F.col("seq"))
    assert sorted((r.id, r.seq) for r in new.collect()) == [("a", 1), ("b", 2)]


def test_keys_and_limits_of_the_other_tables(spark):
    users = spark.createDataFrame(
        [("u1", "a", None), ("u2", "b", "e" * 256), ("u2", "b", "x"), ("u3", None, "x")],
        "user_id string, customer_id string, email string",
    ).withColumn("created_at", F.lit(AT))
    tenants = spark.createDataFrame([("a",)], "customer_id string")
    assert [r.user_id for r in validation.orphans(users, tenants, "users").collect()] == ["u2", "u2"]
    assert [(r.user_id, r.copies) for r in validation.duplicate_keys(users, "users").collect()] == [("u2", 2)]
    _, bad = validation.split_rows(users, "users")
    assert sorted((r.user_id, r.violated) for r in bad.collect()) == [("u2", "email"), ("u3", "customer_id")]
    controls = spark.createDataFrame([("AC-2", "SOC2"), ("AC-2", "GDPR"), ("AC-2", "SOC2")], "control_id string, framework string")
    assert [tuple(r) for r in validation.duplicate_keys(controls, "compliance_controls").collect()] == [("AC-2", "SOC2", 2)]


LOG_ROWS = [
    (AT + timedelta(seconds=s), user, thread, command, argument)
    for s, user, thread, command, argument in [
        (1, "boris[boris] @ h [1]", 42, "Query", "SELECT * FROM job WHERE owner = 7"),
        (2, None, 1, "Execute", " insert into t values ('x') "),
        (2, "a[a]", 2, "Query", "SHOW TABLES"),
        (2, "a[a]", 3, "Query", "SELECT 1"),
        (3, "a[a]", 3, "Connect", "a@h"),
        (4, "a[a]", None, "Query", None),
        (9, "a[a]", 3, "Quit", None),
    ]
]


def log_of(spark, rows=LOG_ROWS):
    return spark.createDataFrame(
        rows, "event_time timestamp, user_host string, thread_id bigint, command_type string, argument string"
    )


def test_log_rows_become_redacted_events(spark):
    rows = {r.action: r for r in querylog.log_events(log_of(spark), "acme", "acme-mysql").collect()}
    assert set(rows) == {"SELECT", "INSERT"} and querylog.log_events(log_of(spark), "a", "b").count() == 3
    assert rows["INSERT"].query == "insert into t values (?)" and rows["INSERT"].userId == "unknown"
    ids = lambda rs: [r.eventId for r in querylog.log_events(log_of(spark, rs), "a", "b").collect()]
    assert ids(LOG_ROWS) == ids(LOG_ROWS)
    other_thread = [(*LOG_ROWS[0][:2], 43, *LOG_ROWS[0][3:])]
    assert ids(LOG_ROWS[:1]) != ids(other_thread)
    assert all(r.rawLog is None for r in rows.values())


def test_poll_batches_and_marks(spark):
    log = log_of(spark)
    assert [r.thread_id for r in querylog.collect_batch(log, AT, 2).collect()] == [42, 1]
    assert querylog.drained_batch(log, AT, 2).count() == 4  # ties at the last time are read too
    marks = one(querylog.checkpoints(log, AT, 2))
    assert (marks.rows_read, marks.mark.second, marks.log_maximum.second) == (4, 2, 9)
    after = one(querylog.checkpoints(log, AT + timedelta(seconds=20), 2))
    assert after.rows_read == 0 and after.mark.second == 20 and after.log_maximum.second == 20


def test_overlapping_polls_collapse(spark):
    events = querylog.log_events(log_of(spark), "acme", "m")
    twice = events.unionByName(events)
    assert keyed.collapse_replays(twice, "eventId").count() == 3


def test_one_failing_collector_does_not_stop_the_rest(spark):
    done, committed = [], []

    def broken():
        raise RuntimeError("source is down")

    jobs = [
        collectors.Collector("a", broken, lambda: committed.append("a")),
        collectors.Collector("b", lambda: querylog.log_events(log_of(spark), "t", "b"), lambda: committed.append("b")),
        collectors.Collector("c", lambda: querylog.log_events(log_of(spark, LOG_ROWS[4:5]), "t", "c"), lambda: committed.append("c")),
    ]
    assert collectors.poll(jobs, lambda df: done.append(df.count())) == {"a": False, "b": True, "c": True}
    assert (done, committed) == ([3, 0], ["b", "c"])

    def refuse(df):
        raise RuntimeError("not accepted")

    assert collectors.poll(jobs[1:2], refuse) == {"b": False} and committed == ["b", "c"]
    assert {r.source for r in collectors.collect_all(jobs[1:]).collect()} == {"b"}


def test_reader_options():
    from trailwarden.sources.events import kafka_options

    assert kafka_options("h:9092", "audit-events", "g", minPartitions="64")["startingOffsets"] == "earliest"
    split = querylog.jdbc_options("jdbc:x", "u", "p", lower="2024-01-01", upper="2024-02-01", partitions=16)
    assert split["partitionColumn"] == "event_time" and split["numPartitions"] == "16"


def test_enriched_report_has_no_hipaa_events(events_of):
    events = enrich(events_of(*[{"type": t} for t in ("DATA_EXPORT", "AUTH_EVENT", "API_CALL")]))
    counts = {r.framework: r.events for r in reports.report_summary(events).collect()}
    assert counts == {"SOC2": 3, "GDPR": 1, "HIPAA": 0}


def test_working_folder(spark):
    from trailwarden import session

    class Unset:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "local[2]", "app-1"

    class Cluster(Unset):
        class sparkContext:
            master, applicationId = "yarn", "app-2"

    assert session.shared_root(Unset) == session.shared_root(Unset)
    with pytest.raises(ValueError):
        session.shared_root(Cluster)
    assert session.new_workdir(spark, "x") != session.new_workdir(spark, "x")
