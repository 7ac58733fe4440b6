"""Alert-rule conditions: accepted language, error handling, sandbox."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailwarden.operators.conditions import (
    ConditionError,
    compile_all,
    compile_condition,
    lifted,
    rule_errors,
)
from trailwarden.operators import matching
from trailwarden.operators.matching import match_rules, prepare_rules

FULL = {
    "type": "DATA_EXPORT", "resource": "billing_ledgers", "ipAddress": "198.51.100.23", "riskLevel": "HIGH",
    "anomalous": True, "tags": {"k": "v"}, "action": "yes", "userAgent": "",
}
BARE = {"type": "AUTH_EVENT", "resource": None, "ipAddress": "172.16.4.9", "riskLevel": None, "anomalous": True}

# condition, matches FULL, matches BARE
CASES = [
    ("anomalous && resource == 'billing_ledgers'", True, False),
    ("resource == 'archive_ledgers'", False, False),
    ("resource.contains('billing')", True, False),
    ("!ipAddress.startsWith('172.')", True, False),
    ("ipAddress != null && !ipAddress.startsWith('172.')", True, False),
    # a failed operand fails the whole unless an earlier one decided
    ("resource.contains('billing') || anomalous", True, False),
    ("anomalous || resource.contains('billing')", True, True),
    ("!anomalous && resource.contains('x')", False, False),
    ("!(resource.contains('zzz'))", True, False),
    ("(resource.contains('zzz') || false) || anomalous", True, False),
    ("resource == null || resource.contains('billing')", True, True),
    ("resource.toLowerCase() == null", False, False),
    ("resource == null", False, True),
    ("resource.length() == 15 and resource.endsWith(\"gers\")", True, False),
    ("resource.equals('billing_ledgers') and not resource.isEmpty()", True, False),
    ("resource.equalsIgnoreCase('BILLING_LEDGERS')", True, False),
    ("resource.toUpperCase().trim() eq 'BILLING_LEDGERS'", True, False),
    ("resource.contains(action)", False, False),
    ("action.contains(resource)", False, False),
    ("userAgent.isBlank()", True, False),
    # enumerated values are not texts; their names are
    ("type == 'DATA_EXPORT'", False, False),
    ("type != 'DATA_EXPORT'", True, True),
    ("type.name() == 'DATA_EXPORT'", True, False),
    ("riskLevel.name() == 'HIGH'", True, False),
    ("riskLevel == null", False, True),
    ("riskLevel.ordinal() >= 2", True, False),
    ("riskLevel < null or riskLevel > null", True, False),
    # ordering and null ranks
    ("resource < 'd'", True, True),
    ("resource >= 'd'", False, False),
    ("resource <= null", False, True),
    # maps, patterns, getters, null-safe calls
    ("tags['k'] == 'v' && tags[k] == 'v'", True, False),
    ("tags['none'] == null && tags.get('none') == null", True, True),
    ("tags.containsKey('k')", True, False),
    ("controls.isEmpty() and tags.size() lt 2", True, True),
    ("resource matches 'bill.*'", True, False),
    ("resource matches 'bill'", False, False),
    ("type matches 'DATA_.*'", True, False),
    ("getResource() == 'billing_ledgers' && isAnomalous()", True, False),
    ("resource?.contains('billing')", True, False),
    ("resource?.toLowerCase() == null", False, True),
    ("anomalous || resource?.contains('x')", True, True),
    # words that read as booleans
    ("action", True, False),
    ("action && anomalous", True, False),
    ("resource", False, False),
    ("TRUE", True, True),
    ("null", False, False),
    ("'it''s' == \"it's\"", True, True),
    ("-1 < 0", True, True),
    ("anomalous == true", True, True),
]

REJECTED = [
    "T(java.io.File).listRoots() != null",
    "new java.util.Random().nextInt() > 0",
    "resource <<>> 'x' ((",
    "@settings.reload()",
    "resource = 'x'",
    "unknownProperty == 1",
    "riskLevel",
    "5",
    "resource.getClass()",
    "resource.matches('x')",
    "controls.![title].size() > 3",
    "type == riskLevel",
    "riskLevel >= 'HIGH'",
    "a < b < c",
    "lambda: 1",
    "__import__('os')",
    "[1, 2]",
    "resource if anomalous else action",
    "reflect('java.util.UUID', 'randomUUID')",
    "tags[resource.trim()] == 'x'",
    "x" * 10_001,
    "(" * 300 + "anomalous" + ")" * 300,
]


def test_conditions_match_as_specified(spark, events_of):
    events = events_of(FULL, BARE)
    columns = [compile_condition(text).matches.alias(f"c{i}") for i, (text, _, _) in enumerate(CASES)]
    full, bare = events.orderBy("eventId").select(*columns).collect()
    wrong = [
        (text, full[i], bare[i]) for i, (text, a, b) in enumerate(CASES) if (full[i], bare[i]) != (a, b)
    ]
    assert wrong == []


@pytest.mark.parametrize("text", REJECTED)
def test_everything_else_is_rejected(text):
    with pytest.raises(ConditionError):
        compile_condition(text)


def test_long_chains_stay_shallow(spark, events_of):
    text = " || ".join(["resource.contains('zzz')"] * 150 + ["anomalous"])
    got = events_of(FULL, BARE).orderBy("eventId").select(compile_condition(text).matches).collect()
    assert [r[0] for r in got] == [True, False]


def test_runs_of_negations_and_deep_nesting(spark, events_of):
    even, odd = "!" * 400 + "anomalous", "!" * 401 + "anomalous"
    deep = "anomalous"
    for _ in range(90):
        deep = f"(anomalous && (false || {deep}))"
    got = events_of(FULL).select(*(compile_condition(t).matches for t in (even, odd, deep))).first()
    assert tuple(got) == (True, False, True)


def test_enum_text_comparison_warns():
    assert compile_condition("type == 'AUTH_EVENT'").warnings


def test_malformed_patterns_disable_only_their_rule(spark, rules_of):
    texts = ["resource matches '('", "resource matches 'a)|(b'", "anomalous"]
    conditions = compile_all(spark, texts)
    assert set(conditions.errors) == set(texts[:2])
    listed = rule_errors(rules_of(*[{"conditionExpression": t} for t in texts]), conditions).collect()
    assert {r.ruleId for r in listed} == {"r0", "r1"}
    assert conditions.match(F.lit(3)) is not None


MORE = [
    ("action == 'y' 'es'", True, False),
    ("action == 'it''s' or resource == \"billing_ledgers\"", True, False),
    ("resource.length() > 14.5 and -1 < resource.length()", True, False),
    ("tags[\"k\"] == 'v' and action matches 'y.s' and 007 == 7", True, False),
    ("'\x01s' == '\x01s'", True, True),
]


def test_shapes_with_their_values_match_as_the_texts_do(spark, events_of):
    events = events_of(FULL, BARE)
    cases = CASES + MORE
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "n int, text string")
    shaped = texts.withColumn("_", lifted(F.col("text"))).select("n", "text", "_.*")
    shapes = {r.n: r.ruleShape for r in shaped.select("n", "ruleShape").collect()}
    conditions = compile_all(spark, sorted(set(shapes.values())))
    ids = spark.createDataFrame([(n, conditions.ids[s]) for n, s in shapes.items()], "n int, id int")
    rows = events.crossJoin(shaped.join(ids, "n")).select("n", "eventId", conditions.match(F.col("id")).alias("holds")).collect()
    got = {(r.n, r.eventId): r.holds for r in rows}
    for n, (text, full, bare) in enumerate(cases):
        assert (got[n, "evt-0"], got[n, "evt-1"]) == (full, bare), text


def test_shapes_leave_out_texts_and_numbers_only(spark):
    texts = ["a == 'x' and b > 12.5", 'a == "it""s" and b > 3.5', "user1 == 5", "a matches ('x') and b == 'y' and c == 1",
             "a == 'x", "\x01s == 1", "a == 12345678901234567890", "'x' + 1"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").select("n", lifted(F.col("t")).alias("_")).select("n", "_.*")
    rows = frame.orderBy("n").collect()
    assert rows[0].ruleShape == rows[1].ruleShape == "\x01a == \x01s and b > \x01d"
    assert (rows[1].ruleTexts, rows[1].ruleDecimals) == (['it"s'], [3.5])
    assert (rows[2].ruleShape, rows[2].ruleIntegers) == ("\x01user1 == \x01i", [5])
    assert rows[3].ruleShape == "\x01a matches ('x') and b == \x01s and c == 1"
    assert rows[4].ruleShape == texts[4] and rows[6].ruleShape == texts[6]
    for row in rows[4:]:
        with pytest.raises(ConditionError):
            compile_condition(row.ruleShape)
    with pytest.raises(ConditionError):  # no text of a tenant's own is a parameter
        compile_condition(rows[5].ruleShape)


def test_a_condition_per_rule_is_one_shape_and_a_join_key(spark, events_of, rules_of):
    rules = rules_of(*[
        {"customerId": "cust-1", "conditionExpression": f"anomalous and userId == 'u{i}'", "eventType": "AUTH_EVENT" if i == 3 else None}
        for i in range(matching.KEYED_RULES)
    ], {"customerId": "cust-1", "conditionExpression": "resource == 'r'"})
    prepared = prepare_rules(rules)
    assert len(prepared.conditions.ids) == 2
    events = events_of(
        {"userId": "u1", "anomalous": True, "resource": "r"}, {"userId": "u2"}, {"userId": "u3", "anomalous": True},
        {"userId": None, "anomalous": True}, {"userId": "u3", "type": "AUTH_EVENT", "anomalous": True})
    want = {("evt-0", "r1"), ("evt-0", f"r{matching.KEYED_RULES}"), ("evt-4", "r3")}
    none = {("evt-1", None), ("evt-2", None), ("evt-3", None)}
    for small in (True, False):
        for how, expected in (("inner", want), ("left", want | none)):
            found = match_rules(events, prepared, how, small).select("eventId", "ruleId")
            assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
        plan = match_rules(events, prepared, "inner", small)._jdf.queryExecution().optimizedPlan().toString()
        assert "userId=" in plan
