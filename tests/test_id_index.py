"""The id index, the version log, durable marks, the agent's files and one-pass reports."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from conftest import AT

from trailwarden.operators.enrich import enrich
from trailwarden.operators.reports import framework_lines, report_documents
from trailwarden.sinks import tables as tb
from trailwarden.sinks.folders import folders
from trailwarden.sinks.idindex import MERGED, IdIndex
from trailwarden.sinks.purge import purge_metadata
from trailwarden.sources import collectors
from trailwarden.sources.marks import Mark, Marks, StaleMark, log_collector


def ids_of(spark, *names, at=AT):
    return spark.createDataFrame([(n, at) for n in names], "event_id string, occurred_at timestamp")


def claimed(frame):
    return sorted(r.event_id for r in frame.collect())


def test_an_id_is_claimed_once(spark, tmp_path):
    index = IdIndex(str(tmp_path / "ids"), 4)
    assert claimed(index.claim(ids_of(spark, "a", "b", "a"), "w", 0)) == ["a", "b"]
    assert claimed(index.claim(ids_of(spark, "b", "c"), "w", 1)) == ["c"]
    assert claimed(index.claim(ids_of(spark, "a", "c", "d"), "other", 1)) == ["d"]
    for _ in range(2):  # replays do not meet themselves
        assert claimed(index.claim(ids_of(spark, "b", "c"), "w", 1)) == ["c"]
        assert claimed(index.claim(ids_of(spark, "a", "b"), "w", 0)) == ["a", "b"]
    assert claimed(index.claim(ids_of(spark), "w", 2)) == []
    many = [f"m{i}" for i in range(50)]  # more than are looked up by value
    assert len(claimed(index.claim(ids_of(spark, *many, "a"), "w", 3))) == 50
    assert claimed(index.claim(ids_of(spark, *many), "w", 4)) == []


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    index = IdIndex(str(tmp_path / "ids"), 16)
    index.claim(ids_of(spark, *[f"e{i}" for i in range(300)]), "w", 0)
    assert len(folders(spark, index.root, "bucket=")) == 16
    one = ids_of(spark, "e7")
    rows = index.stored(spark, one, "w", 1)
    read = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    assert read == {str(one.select(index.bucket()).first()[0])}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "e7" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert [r.event_id for r in rows.collect()] == ["e7"]


def test_a_first_batch_asks_nobody(spark, tmp_path, monkeypatch):
    asked, stored = [], IdIndex.stored
    monkeypatch.setattr(IdIndex, "stored", lambda *a: asked.append(a[-1]) or stored(*a))
    index = IdIndex(str(tmp_path / "ids"), 4)
    for _ in range(2):  # its replay neither
        assert claimed(index.claim(ids_of(spark, "a", "b", "a"), "w", 0)) == ["a", "b"]
    assert claimed(index.claim(ids_of(spark, "b", "c", "c"), "w", 1)) == ["c"]
    assert asked == [1]


def test_many_rows_of_few_ids_are_looked_up_by_value(spark, tmp_path, monkeypatch):
    index = IdIndex(str(tmp_path / "ids"), 4)
    index.claim(ids_of(spark, *[f"e{i}" for i in range(50)]), "w", 0)
    copies = ids_of(spark, *["e7", "e8"] * 20)
    wanted = lambda: sorted(r.event_id for r in index.stored(spark, copies, "w", 1).where("event_id IN ('e7', 'e8')").collect())
    assert wanted() == ["e7", "e8"] and sorted(r.event_id for r in index.stored(spark, copies, "w", 1).collect()) == ["e7", "e8"]
    monkeypatch.setattr("trailwarden.sinks.idindex.PUSHED_ROWS", 10)  # too many rows to ask: the buckets as they are
    assert wanted() == ["e7", "e8"] and index.stored(spark, copies, "w", 1).count() > 2


def test_full_buckets_are_merged(spark, tmp_path):
    index = IdIndex(str(tmp_path / "ids"), 2)
    for k in range(3):
        index.claim(ids_of(spark, *[f"{k}-{i}" for i in range(20)]), "w", k)
    assert index.compact(spark, 4) == 0
    assert index.compact(spark, 3) == 2
    assert {n.split("/")[1] for n in folders(spark, index.root, "bucket=", below="*/*")} == {f"writer={MERGED}"}
    assert claimed(index.claim(ids_of(spark, "1-3", "new"), "w", 3)) == ["new"]
    assert claimed(index.claim(ids_of(spark, "2-0"), "w", 2)) == ["2-0"]  # a replay, though its rows are merged


def test_purged_ids_may_come_again(spark, events_of, tmp_path):
    stores = tb.Stores(str(tmp_path), buckets=4)
    old, new = {"eventId": "old", "timestamp": AT - timedelta(days=50)}, {"eventId": "new"}
    tb.write_metadata(events_of(old, new), stores, 0)
    purge_metadata(spark, stores, AT, days=30)
    tb.write_metadata(events_of(old, new), stores, 1)
    rows = tb.read_table(spark, stores, "metadata").select("event_id", "batch_id").collect()
    assert sorted(map(tuple, rows)) == [("new", 0), ("old", 1)]


def test_second_look_reads_the_tenants_bucket(spark, events_of, tmp_path):
    stores = tb.Stores(str(tmp_path), buckets=8)
    rows = [{"eventId": f"e{i}", "customerId": f"t{i % 20}"} for i in range(60)]
    tb.write_evidence(enrich(events_of(*rows)), stores, 0)
    window = tb.read_evidence_window(spark, stores, "t3", AT - timedelta(days=1), AT + timedelta(days=1))
    assert sorted(r.eventId for r in window.collect()) == ["e23", "e3", "e43"]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(tenants") == 1


def test_marks_only_move_on(spark, tmp_path):
    marks = Marks(str(tmp_path / "marks"))
    assert marks.current(spark, "db/1") == Mark(0, None)
    first = marks.advance(spark, "db/1", Mark(0, None), AT)
    assert first.version == 1 and marks.current(spark, "db/1").at is not None
    seen = marks.current(spark, "db/1")
    marks.advance(spark, "db/1", seen, seen.at + timedelta(hours=1))
    with pytest.raises(StaleMark):  # a second poller that started from the same mark
        marks.advance(spark, "db/1", seen, seen.at + timedelta(hours=2))
    latest = marks.current(spark, "db/1")
    with pytest.raises(StaleMark):
        marks.advance(spark, "db/1", latest, seen.at)
    assert latest.version == 2 and marks.current(spark, "other").version == 0
    # a version whose write did not finish does not count
    (Path(marks.root) / "db%2F1" / "version=3").mkdir()
    assert marks.current(spark, "db/1") == latest


def test_a_lost_delivery_is_read_again(spark, tmp_path):
    log = spark.createDataFrame(
        [(AT + timedelta(minutes=i // 2), "u[u] @ h", i, "Query", f"SELECT {i} FROM t{i}") for i in range(10)],
        "event_time timestamp, user_host string, thread_id bigint, command_type string, argument string")
    marks, seen = Marks(str(tmp_path / "marks")), []

    def poll(fail):
        def deliver(events):
            seen.append(sorted(r.query for r in events.collect()))
            if fail:
                raise RuntimeError("lost")

        return collectors.poll([log_collector(log, marks, "c", "r", AT - timedelta(days=1), 3)], deliver)

    assert list(poll(False).values()) == [True] and len(seen[0]) == 4  # a tie is read to its end
    assert list(poll(True).values()) == [False]
    assert list(poll(False).values()) == [True] and seen[1] == seen[2]
    poll(False)
    poll(False)  # nothing is left
    assert sorted(q for part in (seen[0], *seen[2:]) for q in part) == sorted(f"SELECT ? FROM t{i}" for i in range(10))
    assert seen[-1] == []


def test_reports_in_one_pass(spark, events_of, tmp_path):
    events_of({"type": "DATA_EXPORT"}, {"type": "AUTH_EVENT"}, {"type": "DATA_EXPORT"}).write.parquet(str(tmp_path / "e"))
    events = enrich(spark.read.parquet(str(tmp_path / "e")))
    documents = report_documents(events, "c", AT, AT, ("SOC2", "GDPR", "XYZ"))
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    rows = documents.collect()
    heads = {r.framework: r.line for r in rows if r.part == 3}
    assert heads == {"SOC2": "Events: 3", "GDPR": "Events: 2", "XYZ": "Events: 0"}
    assert {r.framework: r.line for r in rows if r.part == 0}["XYZ"] == "XYZ Report"
    assert sum(r.part == 4 for r in rows) == 5 == framework_lines(events, ("SOC2", "GDPR")).count()
