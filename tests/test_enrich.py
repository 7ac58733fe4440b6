from __future__ import annotations

from pyspark.sql import functions as F
from conftest import one

from trailwarden.functions.eventjson import decode_events, event_json
from trailwarden.operators import enrich as en
from trailwarden.schemas import EVENT_TYPES


def test_anomaly_rules(events_of):
    got = en.detect_anomalies(
        events_of(
            {"type": "DATA_EXPORT", "riskLevel": "CRITICAL"},
            {"type": "PERMISSION_CHANGE", "riskLevel": "CRITICAL"},
            {"type": "PERMISSION_CHANGE", "riskLevel": "HIGH", "anomalous": True},
            {"type": "DATABASE_QUERY", "riskLevel": None},
        )
    ).orderBy("eventId")
    assert [(r.anomalous, r.riskLevel) for r in got.collect()] == [
        (True, "HIGH"), (True, "HIGH"), (False, "HIGH"), (False, None),
    ]


def test_controls_replace_what_was_there(spark, events_of):
    old = [("OLD", "SOC2", "x", None, [], [])]
    events = events_of(*[{"type": t, "controls": old} for t in EVENT_TYPES], {"type": None, "controls": old})
    got = {r.type: [c.controlId for c in r.controls] for r in en.classify_controls(events).collect()}
    assert got == {
        "DATABASE_QUERY": ["AC-2"], "API_CALL": ["AC-2"], "AUTH_EVENT": ["AC-2", "IA-2"], "FILE_ACCESS": ["AU-2"],
        "PERMISSION_CHANGE": ["AC-6"], "DATA_EXPORT": ["AU-2", "Art-30"], None: [],
    }


def test_more_control_rows_can_be_supplied(spark, events_of):
    rows = spark.createDataFrame(
        [("API_CALL", 1, "164.312", "HIPAA", "Audit Controls"), ("API_CALL", 0, "AC-2", "SOC2", "Account Management")],
        "eventType string, position int, controlId string, framework string, name string",
    )
    got = one(en.classify_controls(events_of({"type": "API_CALL"}), rows))
    assert [c.framework for c in got.controls] == ["SOC2", "HIPAA"]


def test_user_context_is_put_only_if_absent(events_of):
    tag = "enrichment.userContext"
    events = events_of(
        {"userId": "u"}, {}, {"tags": {tag: "preset", "a": "b"}}, {"tags": {tag: None, "a": "b"}}, {"tags": None, "userId": "u"}
    )
    got = [r.tags for r in en.add_user_context(events).orderBy("eventId").collect()]
    assert got == [
        {tag: "resolved"}, {tag: "unknown"}, {tag: "preset", "a": "b"}, {tag: "unknown", "a": "b"}, {tag: "resolved"},
    ]


def test_steps_run_by_order(events_of):
    def mark(name):
        return lambda df: df.withColumn("action", F.concat_ws(",", "action", F.lit(name)))

    steps = [en.Step(mark("c"), 30), en.Step(mark("a")), en.Step(mark("b"), 20)]
    assert one(en.enrich(events_of({}), steps)).action == "a,b,c"


def test_json_round_trip_and_defaults(spark, events_of):
    events = en.enrich(events_of({"type": "DATA_EXPORT", "resource": 'q"uote', "riskLevel": "LOW"}))
    back = decode_events(events.select(event_json().alias("value"))).drop("decode_error", "value")
    assert back.drop("tags").collect() == events.drop("tags").collect()
    sparse = spark.createDataFrame(
        [
            ('{"eventId":"e","customerId":"c","type":"API_CALL","timestamp":"2024-01-01T00:00:00Z"}',),
            ('{"eventId":"e","customerId":"c","type":"API_CALL","timestamp":1704067200.0,"riskLevel":null,"extra":1}',),
            ('{"eventId":"e","customerId":"c","type":"API_CALL","timestamp":"x"}',),
            ("[]",),
            (None,),
        ],
        "value string",
    )
    rows = decode_events(sparse).collect()
    assert [(r.riskLevel, r.decode_error) for r in rows[:2]] == [("LOW", None), (None, None)]
    assert (rows[0].controls, rows[0].tags, rows[0].anomalous) == ([], {}, False)
    assert rows[2].decode_error == "invalid timestamp"
    assert rows[3].decode_error and rows[4].decode_error == "malformed json"
