from __future__ import annotations

import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import Row

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trailwarden.schemas import ALERT_RULE, AUDIT_EVENT  # noqa: E402
from trailwarden.session import build_session  # noqa: E402
from trailwarden.sources.rules import fill_rule_defaults  # noqa: E402

AT = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events_of(spark):
    """DataFrame of events from dicts; absent fields take the model's defaults."""

    def build(*rows: dict):
        base = {name: None for name in AUDIT_EVENT.fieldNames()} | {
            "customerId": "cust-1", "timestamp": AT, "type": "DATABASE_QUERY", "controls": [],
            "riskLevel": "LOW", "anomalous": False, "tags": {},
        }
        full = [base | {"eventId": f"evt-{i}"} | row for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in AUDIT_EVENT.fieldNames()) for r in full], AUDIT_EVENT)

    return build


@pytest.fixture(scope="session")
def rules_of(spark):
    def build(*rows: dict):
        base = {name: None for name in ALERT_RULE.fieldNames()} | {"customerId": "harbor", "notificationChannels": ["slack"]}
        full = [base | {"ruleId": f"r{i}"} | row for i, row in enumerate(rows)]
        frame = spark.createDataFrame([tuple(r[n] for n in ALERT_RULE.fieldNames()) for r in full], ALERT_RULE)
        return fill_rule_defaults(frame)

    return build


def one(df) -> Row:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
