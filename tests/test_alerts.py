"""Rule files, matching, dispatch and alert wording."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from conftest import one

from trailwarden.operators import matching
from trailwarden.sources.rules import load_rules

ROTATION = {"customerId": "harbor", "type": "AUTH_EVENT", "action": "KEY_ROTATED", "riskLevel": "MEDIUM"}


def matched(events, rules, **options):
    rows = matching.match_rules(events, rules, **options).select("ruleId", "eventId").collect()
    return sorted((r.ruleId, r.eventId) for r in rows)


def fired(events, rules):
    return {r.eventId: r.fired for r in matching.dispatch_counts(events, rules).collect()}


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(
        json.dumps(
            [
                {"ruleId": "a", "customerId": "harbor", "notificationChannels": ["slack"], "unknownField": 1},
                {"ruleId": "b", "customerId": "harbor", "enabled": False},
                {"ruleId": "c", "customerId": "other"},
            ]
        )
    )
    rules = load_rules(spark, str(path))
    assert {r.ruleId: (r.enabled, r.notificationChannels) for r in rules.collect()} == {
        "a": (True, ["slack"]), "b": (False, []), "c": (True, []),
    }
    counts = {r.customerId: (r.rule_count, r.enabled_count) for r in matching.rules_by_customer(rules).collect()}
    assert counts == {"harbor": (2, 1), "other": (1, 1)}
    for nothing in (None, "  ", str(tmp_path / "missing.json")):
        assert load_rules(spark, nothing).count() == 0
    path.write_text('[{"ruleId": "a", ')
    with pytest.raises(Exception):
        load_rules(spark, str(path)).collect()


def test_criteria_all_apply(events_of, rules_of):
    events = events_of(
        ROTATION, ROTATION | {"riskLevel": "HIGH"}, ROTATION | {"riskLevel": None}, ROTATION | {"customerId": "other"},
        ROTATION | {"type": "API_CALL", "riskLevel": "CRITICAL"},
    )
    rules = rules_of(
        {"eventType": "AUTH_EVENT"},
        {"riskThreshold": "HIGH"},
        {"riskThreshold": "LOW", "enabled": False},
        {"conditionExpression": "action == 'KEY_ROTATED' && type.name() == 'API_CALL'"},
        {"conditionExpression": "broken ((", "eventType": "AUTH_EVENT"},
    )
    expected = [
        ("r0", "evt-0"), ("r0", "evt-1"), ("r0", "evt-2"), ("r1", "evt-1"), ("r1", "evt-4"), ("r3", "evt-4"),
    ]
    assert matched(events, rules) == expected
    # a rule table too big to broadcast gives the same matches
    assert matched(events, rules, broadcast_rules=False) == expected


def test_many_conditions_need_one_reading_of_the_events(spark, events_of, rules_of, tmp_path):
    path = str(tmp_path / "events")
    events_of(ROTATION, ROTATION | {"action": "A3"}, ROTATION | {"action": "none"}).write.parquet(path)
    events = spark.read.parquet(path)
    rules = rules_of(*[{"conditionExpression": f"action == 'A{i}'", "customerId": "harbor"} for i in range(230)], {"customerId": "harbor"})
    assert matched(events, rules) == [("r230", "evt-0"), ("r230", "evt-1"), ("r230", "evt-2"), ("r3", "evt-1")]
    assert fired(events, rules) == {"evt-0": 1, "evt-1": 2, "evt-2": 1}
    left = matching.match_rules(events, rules, how="left")
    assert left.count() == 4
    assert left._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_an_unknown_level_never_fires(events_of, rules_of):
    assert matched(events_of(ROTATION | {"riskLevel": "CRITICAL"}), rules_of({"customerId": "harbor", "riskThreshold": "SEVERE"})) == []


@pytest.mark.parametrize(
    ("document", "said"),
    [
        ('[{"ruleId": "a", "customerId": "t", "riskThreshold": "SEVERE"}]', "SEVERE"),
        ('[{"ruleId": "a", "customerId": "t", "eventType": "LOGIN"}]', "LOGIN"),
        ('[{"ruleId": "a"}]', "customerId"),
        ('[{"customerId": "t"}]', "ruleId"),
        ('{"ruleId": "a", "customerId": "t"}', "array"),
    ],
)
def test_a_faulty_rule_file_is_refused(spark, tmp_path, document, said):
    path = tmp_path / "rules.json"
    path.write_text(document)
    with pytest.raises(ValueError, match=said):
        load_rules(spark, str(path))


def test_rejected_rules_are_listed(rules_of):
    rules = rules_of(
        {"conditionExpression": "anomalous"}, {"conditionExpression": "x" * 10_001}, {"conditionExpression": "action =="},
        {"conditionExpression": "action ==", "enabled": False}, {"conditionExpression": None},
    )
    assert sorted(r.ruleId for r in matching.rejected_rules(rules).collect()) == ["r1", "r2"]


@pytest.mark.parametrize(
    ("rule", "count"),
    [
        ({"conditionExpression": "action == 'KEY_ROTATED'", "notificationChannels": ["slack", "email"]}, 2),
        ({"conditionExpression": "action == 'KEY_CREATED'"}, 0),
        ({"notificationChannels": ["pager", "slack"]}, 1),
        ({"notificationChannels": ["email", "email"]}, 2),
        ({"customerId": "other"}, 0),
    ],
)
def test_dispatch_counts(events_of, rules_of, rule, count):
    assert fired(events_of(ROTATION), rules_of(rule)) == {"evt-0": count}


def test_unknown_channels_are_listed(events_of, rules_of):
    rows = matching.explode_channels(
        matching.match_rules(events_of(ROTATION), rules_of({"notificationChannels": ["pager", "slack", None]}))
    )
    assert [r.channel for r in matching.undeliverable(rows).orderBy("channelPos").collect()] == ["pager", None]
    assert [r.channel for r in matching.deliverable(rows).collect()] == ["slack"]


def test_wording(events_of, rules_of):
    event = {
        "customerId": "harbor", "type": "AUTH_EVENT", "action": "KEY_ROTATED", "userId": "mira",
        "ipAddress": "198.51.100.23", "riskLevel": "HIGH", "anomalous": True,
        "timestamp": datetime(2025, 3, 14, 23, tzinfo=timezone.utc),
    }
    rules = rules_of({"name": "Key rotated at night", "notificationChannels": ["slack", "email"]})
    slack, email = matching.build_alerts(events_of(event), rules, tag="Tag").orderBy("channel_pos").collect()
    assert slack.subject == "[Tag] Key rotated at night - HIGH risk for harbor"
    assert slack.body == (
        "Rule: Key rotated at night (r0)\nCustomer: harbor\nEvent: AUTH_EVENT KEY_ROTATED on -\n"
        "User: mira from 198.51.100.23\nRisk: HIGH (anomalous)\nEvent id: evt-0 at 2025-03-14T23:00:00Z"
    )
    assert json.loads(slack.payload) == {"text": f"*{slack.subject}*\n```{slack.body}```"}
    assert json.loads(email.payload) == {"subject": slack.subject, "body": slack.body}
    assert slack.alert_id != email.alert_id


def test_unnamed_and_unrated(events_of, rules_of):
    row = one(matching.build_alerts(events_of({"customerId": "harbor", "riskLevel": None, "type": None}), rules_of({}), tag="T"))
    assert row.subject == "[T] r0 - unrated risk for harbor"
    assert "Event: null - on -" in row.body and row.body.splitlines()[4] == "Risk: unrated"


def test_a_channel_can_be_added(events_of, rules_of):
    renderers = {"pager": lambda subject, body: F.upper(subject)}
    rows = matching.build_alerts(events_of(ROTATION), rules_of({"notificationChannels": ["pager", "slack"]}), "T", renderers)
    assert one(rows).payload == "[T] R0 - MEDIUM RISK FOR HARBOR"
