"""Every catalog query against its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from trailwarden.plans import catalog, fixtures
from trailwarden.plans.catalog import all_queries
from trailwarden.plans.oracles import all_oracles

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def in_name_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_each_query_has_a_twin():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries()) and set(all_oracles()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, SF_DIR)
    cursor = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert in_name_order(frame.columns, frame.collect()) == in_name_order(columns, cursor.fetchall())


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and frame.columns[0] == "alert_id"


def test_deliveries_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "new_workdir", lambda spark, name: str(tmp_path / name))
    base = spark.read.parquet(f"{SF_DIR}/events.parquet")
    base.repartition(4).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    rows = all_queries()["stream_insert_many"](spark, str(tmp_path / "sf"))
    assert rows.count() == base.count()
    root = tmp_path / "insert-many"
    assert len(list((root / "deliveries").glob("part-*"))) == 5 * 4
    assert len(list((root / "_checkpoints" / "commits").glob("[0-9]*"))) == 5


def test_deliveries_make_only_their_own_events(spark):
    whole = fixtures.replayed_events(spark, SF_DIR)
    parts = [fixtures.delivery(spark, SF_DIR, k) for k in range(5)]
    rows = lambda df: sorted((r.seq, r.customerId, r.riskLevel, r.eventId) for r in df.collect())
    assert sorted(sum(map(rows, parts), [])) == rows(whole)
    for part in parts:
        plan = part._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("Filter" in line for line in plan[next(i for i, x in enumerate(plan) if "Generate" in x) + 1 :])
