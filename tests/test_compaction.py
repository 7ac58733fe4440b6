"""Merged batch folders: replays, half-done merges, purges and pruned reads."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import AT
from pyspark.sql import functions as F

from trailwarden.operators.enrich import enrich
from trailwarden.sinks import compaction, tables as tb
from trailwarden.sinks.idindex import MERGED
from trailwarden.sinks.purge import purge_metadata, surviving

TABLES = ("evidence", "versions", "metadata")


def deliver(stores, events_of, batch, *rows):
    frame = enrich(events_of(*rows)).withColumn("seq", F.monotonically_increasing_id())
    tb.fan_out(frame, tb.default_sinks(stores)[:2], batch)


def stored(spark, stores, table):
    key = "event_id" if table == "metadata" else "eventId"
    return sorted(tuple(r) for r in tb.read_table(spark, stores, table).select(key, "writer", "batch_id").collect())


@pytest.fixture
def four(spark, events_of, tmp_path):
    """Four batches of two days, one event repeated in the last."""
    stores = tb.Stores(str(tmp_path), buckets=2)
    for k in range(4):
        rows = [{"eventId": f"e{k}"}, {"eventId": f"f{k}", "timestamp": AT + timedelta(days=1)}]
        deliver(stores, events_of, k, *rows, *([{"eventId": "e0", "riskLevel": "HIGH"}] if k == 3 else []))
    return stores


def test_merging_changes_no_row(spark, four):
    before = {t: stored(spark, four, t) for t in TABLES}
    assert [compaction.compact_table(spark, four, t, least=3) for t in TABLES] == [2, 1, 2]
    assert {t: stored(spark, four, t) for t in TABLES} == before
    names = {f.name for f in tb.batch_folders(spark, four, "evidence")}
    day = f"event_date={AT.date()}"
    assert {n for n in names if n.startswith(day)} == {f"{day}/writer=main/batch_id=3", f"{day}/writer={MERGED}/batch_id=0"}
    assert compaction.compact_table(spark, four, "evidence", least=3) == 0
    with pytest.raises(ValueError):
        compaction.compact_table(spark, four, "alerts")


def test_a_replayed_batch_replaces_its_merged_rows(spark, events_of, four):
    for t in TABLES:
        compaction.compact_table(spark, four, t, least=3)
    before = {t: stored(spark, four, t) for t in TABLES}
    again = [{"eventId": "e1", "action": "again"}, {"eventId": "f1", "timestamp": AT + timedelta(days=1)}]
    for _ in range(2):
        deliver(four, events_of, 1, *again)
        assert {t: stored(spark, four, t) for t in TABLES} == before
    deliver(four, events_of, 4, {"eventId": "e9"})
    for t in TABLES:  # the replayed batch meets the rows it replaces
        compaction.compact_table(spark, four, t, least=2)
    assert len(stored(spark, four, "evidence")) == len(before["evidence"]) + 1
    assert {r.action for r in tb.read_evidence(spark, four).where("eventId = 'e1'").collect()} == {"again"}
    window = tb.read_evidence_window(spark, four, "cust-1", AT, AT + timedelta(hours=1))
    assert sorted((r.eventId, r.riskLevel) for r in window.collect()) == [
        ("e0", "HIGH"), ("e1", "LOW"), ("e2", "LOW"), ("e3", "LOW"), ("e9", "LOW")]


def test_a_merge_cut_off_half_way(spark, events_of, four, monkeypatch):
    before = stored(spark, four, "metadata")
    monkeypatch.setattr(compaction, "drop_folders", lambda *a: None)  # ends before old folders go
    compaction.compact_table(spark, four, "metadata", least=3)
    assert stored(spark, four, "metadata") == before
    compaction.compact_table(spark, four, "metadata", least=3)  # two merges, of which the last counts
    assert stored(spark, four, "metadata") == before
    monkeypatch.undo()
    compaction.compact_table(spark, four, "metadata", least=3)
    assert stored(spark, four, "metadata") == before
    assert {f.batch for f in tb.batch_folders(spark, four, "metadata", MERGED)} == {2}


def test_purge_of_merged_days(spark, four):
    compaction.compact_table(spark, four, "metadata", least=3)
    deleted, _ = purge_metadata(spark, four, AT + timedelta(days=31, hours=-1), 30)
    assert deleted == 4
    assert sorted(r.event_id for r in surviving(spark, four).collect()) == [f"f{k}" for k in range(4)]
    assert not [f for f in tb.batch_folders(spark, four, "metadata") if f.head == f"event_date={AT.date()}"]


def test_merged_days_are_pruned(spark, four):
    for t in TABLES:
        compaction.compact_table(spark, four, t, least=3)
    inside = tb.read_table(spark, four, "evidence", AT.date(), AT.date())
    assert {f.split("event_date=")[1][:10] for f in inside.inputFiles()} == {str(AT.date())}
    assert inside.count() == 5
