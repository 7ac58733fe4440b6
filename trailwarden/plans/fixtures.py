"""Audit inputs derived from the given test tables, and the fixed parameters.

Every row of the base table takes part; the remainders below only vary the
shape of the derived rows (missing users, invalid types, replays and so on).
"""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.functions.eventjson import empty_controls
from trailwarden.operators.enrich import default_controls
from trailwarden.schemas import EVENT_COLUMNS, USER_CONTEXT_TAG
from trailwarden.sinks.tables import topic_records
from trailwarden.sources.rules import fill_rule_defaults

INGEST_TS = "2026-01-01T00:00:00Z"
REPORT_TENANT = "cust-1"
REPORT_FROM = "2024-01-10T00:00:00Z"
REPORT_TO = "2024-01-20T23:59:59.900Z"
RETENTION_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
RETENTION_DAYS = 20
RETENTION_BATCH = 1000
LOG_TENANT = "acme"
LOG_RESOURCE = "acme-mysql"
WEB_RESOURCE = "acme-crm"
LOG_SINCE = "1995-01-01T00:00:00Z"
LOG_BATCH = 500

_RULES = [
    # id, tenant, name, type, threshold, condition, enabled, channels
    ("r01", "cust-0", "Badge refused", "AUTH_EVENT", None, "action == 'BADGE_REFUSED'", True, ["slack"]),
    ("r02", "cust-1", "Rated file touched", "FILE_ACCESS", "MEDIUM", None, True, ["slack", "email"]),
    ("r03", "cust-2", "Strange table read", None, None, "resource == 'client_register' and anomalous", True, ["email"]),
    ("r04", "cust-2", None, "DATA_EXPORT", "CRITICAL", None, True, ["slack"]),
    ("r05", "cust-3", None, None, "LOW", None, True, ["pager", "slack"]),
    ("r06", "cust-3", "Switched off", None, None, None, False, ["slack"]),
    ("r07", "cust-4", "Client register or strange", None, None, "resource.contains('client') || anomalous", True, ["email"]),
    ("r08", "cust-4", "Inside address", None, None, "ipAddress != null && !ipAddress.startsWith('203.0.')", True, ["slack"]),
    ("r09", "cust-4", None, None, None, "T(java.io.File).listRoots() != null", True, ["slack"]),
    ("r10", "cust-4", None, None, None, "resource", True, ["slack"]),
    ("r11", "cust-0", 'High "risk"', None, "HIGH", "  ", True, ["email", "email"]),
    ("r12", "cust-9", None, None, None, None, True, ["slack"]),
]
RULE_FIELDS = (
    "ruleId", "customerId", "name", "eventType", "riskThreshold", "conditionExpression",
    "enabled", "notificationChannels",
)


def table(spark: SparkSession, sf_dir: str, name: str, streaming: bool = False) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if not streaming:
        return spark.read.parquet(path)
    # A stream takes a table that is one file only when its path is a pattern.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def rules(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(RULE_FIELDS, r)) for r in _RULES]
    text, flag = pa.string(), pa.bool_()
    kinds = [text] * 6 + [flag, pa.list_(text)]
    frame = spark.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema(list(zip(RULE_FIELDS, kinds)))))
    return fill_rule_defaults(frame.withColumn("description", F.lit(None).cast("string")))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per customer of the base table; the tenant is its nation.

    ``document`` says which rule file it belongs to, 5,000 to a file.
    """
    key = F.col("c_custkey")
    kinds = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("DATA_EXPORT")).when(
        F.col("c_mktsegment") == "BUILDING", F.lit("AUTH_EVENT")
    )
    # a few megabytes of customers are many rules: they go to all tasks before their conditions are made
    return table(spark, sf_dir, "customer").repartition("c_custkey").select(
        F.floor(key / 5000).alias("document"),
        F.concat(F.lit("rule-"), key).alias("ruleId"),
        F.concat(F.lit("nation-"), F.col("c_nationkey")).alias("customerId"),
        F.col("c_name").alias("name"),
        kinds.alias("eventType"),
        F.when(F.col("c_acctbal") < 0, F.lit("HIGH")).alias("riskThreshold"),
        F.when(F.col("c_acctbal") > 5000, F.lit("anomalous")).alias("conditionExpression"),
        F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(False)).alias("enabled"),
        F.array(F.lit("slack")).alias("notificationChannels"),
    )


def odd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules per customer with conditions of which half are refused, by key modulo 4."""
    key = F.regexp_extract("ruleId", r"(\d+)", 1).cast("long")
    condition = (
        F.when(key % 4 == 0, F.lit("anomalous and ("))
        .when(key % 4 == 1, F.repeat(F.lit("x"), 10_001))
        .when(key % 4 == 2, F.concat(F.lit("action == 'A"), key.cast("string"), F.lit("'")))
    )
    return fill_rule_defaults(rule_rows(spark, sf_dir)).withColumn("conditionExpression", condition)


def rule_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per customer that waits for the user of the same number."""
    key = F.regexp_extract("ruleId", r"(\d+)", 1)
    return fill_rule_defaults(rule_rows(spark, sf_dir)).withColumns({
        "customerId": F.concat(F.lit("cust-"), (key.cast("long") % 5).cast("string")),
        "eventType": F.lit(None).cast("string"), "riskThreshold": F.lit(None).cast("string"), "enabled": F.lit(True),
        "conditionExpression": F.concat(F.lit("userId == 'user-"), key, F.lit("'")),
    })


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def audit_events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """``seq`` and the 17 event columns, before enrichment, one per base event."""
    base = table(spark, sf_dir, "events", streaming).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    k, kind, user = F.col("k"), F.col("event_type"), _text("user_id")
    query_like = (kind == "click") & (k < 50)
    none = F.lit(None).cast("string")
    columns = {
        "eventId": F.concat(F.lit("evt-"), _text("event_id")),
        "customerId": F.concat(F.lit("cust-"), _text(F.col("user_id") % 5)),
        "userId": F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("user-"), user)),
        "sessionId": F.concat(F.lit("sess-"), user, F.lit("-"), _text(F.to_date("ts"))),
        "timestamp": F.col("ts").cast("timestamp"),
        "type": F.when(kind == "view", F.lit("FILE_ACCESS"))
        .when(kind == "signup", F.lit("AUTH_EVENT"))
        .when(kind == "error", F.lit("PERMISSION_CHANGE"))
        .when(kind == "purchase", F.lit("DATA_EXPORT"))
        .when(k < 50, F.lit("DATABASE_QUERY"))
        .otherwise(F.lit("API_CALL")),
        "resource": F.when(k % 10 == 0, none)
        .when(k % 3 == 0, F.lit("client_register"))
        .when(k % 3 == 1, F.lit("stock_register"))
        .otherwise(F.concat(F.lit("profile:"), user)),
        "action": F.when(kind == "view", F.lit("PROFILE_VIEW"))
        .when(kind == "signup", F.when(k < 30, F.lit("BADGE_REFUSED")).otherwise(F.lit("BADGE_ACCEPTED")))
        .when(kind == "error", F.lit("GRANT"))
        .when(kind == "purchase", F.lit("EXPORT"))
        .when(k < 50, F.lit("SELECT"))
        .otherwise(F.lit("GET")),
        "query": F.when(query_like, F.concat(F.lit("SELECT * FROM customers WHERE id = "), user)),
        "ipAddress": F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), _text(k)))
        .when(k % 4 == 1, none)
        .otherwise(F.concat(F.lit("203.0.113."), _text(k))),
        "controls": empty_controls(),
        "riskLevel": F.when(k == 99, none)
        .when(F.col("value") < 15, F.lit("LOW"))
        .when(F.col("value") < 70, F.lit("MEDIUM"))
        .when(F.col("value") < 110, F.lit("HIGH"))
        .otherwise(F.lit("CRITICAL")),
        "anomalous": F.lit(False),
        "tags": F.when(k % 7 == 0, F.create_map(F.lit(USER_CONTEXT_TAG), F.lit("preset"))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    }
    return base.select(
        F.col("event_id").alias("seq"), *[columns.get(c, none).alias(c) for c in EVENT_COLUMNS]
    )


def replayed_events(spark: SparkSession, sf_dir: str, streaming: bool = False, of: Column | None = None) -> DataFrame:
    """Every event, or those ``of`` holds for, some delivered twice, some ids reused by another tenant."""
    events = audit_events(spark, sf_dir, streaming)
    if of is not None:
        events = events.where(of)

    def copy(offset: int, tenant: Column, level: Column, present: Column) -> Column:
        row = F.struct(
            (F.col("seq") + offset).alias("seq"), tenant.alias("customerId"), level.alias("riskLevel")
        )
        return F.when(present, row)

    tenant, level = F.col("customerId"), F.col("riskLevel")
    copies = F.array(
        copy(0, tenant, level, F.lit(True)),
        copy(10_000_000_000, tenant, level, F.col("seq") % 10 == 0),
        copy(20_000_000_000, F.lit("cust-x"), F.lit("CRITICAL"), F.col("seq") % 25 == 0),
    )
    exploded = events.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    changed = ("customerId", "riskLevel")
    return exploded.select(
        F.col("_copy.seq").alias("seq"),
        *[F.col(f"_copy.{c}").alias(c) if c in changed else F.col(c) for c in EVENT_COLUMNS],
    )


def delivery(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k-th of five deliveries of ``replayed_events``: first copies in four, every copy in one after it."""
    late = F.col("seq") >= 10_000_000_000
    of = F.when(late, F.pmod("seq", F.lit(4)) + 1).otherwise(F.pmod("seq", F.lit(4)))
    # a copy's number leaves the same remainder as its event's: the events of other deliveries need not be made
    own = F.pmod("seq", F.lit(4)).isin(k, k - 1)
    return replayed_events(spark, sf_dir, of=own).where(of == k)


def moved(events: DataFrame) -> DataFrame:
    """Later versions of every seventh event, ten days on."""
    later = F.col("timestamp") + F.expr("INTERVAL 10 DAYS")
    return events.where(F.col("seq") % 7 == 0).withColumn("timestamp", later)


def more_controls(spark: SparkSession) -> DataFrame:
    """The built-in controls and two of a third framework."""
    more = spark.range(2).select(
        F.when(F.col("id") == 0, F.lit("FILE_ACCESS")).otherwise(F.lit("AUTH_EVENT")).alias("eventType"),
        (F.col("id") + 100).alias("position"),
        F.concat(F.lit("own-"), F.col("id")).alias("controlId"), F.lit("HIPAA").alias("framework"), F.lit("Own control").alias("name"),
    )
    return default_controls(spark).unionByName(more)


def raw_records(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """The events as keyed JSON records of the raw topic."""
    return topic_records(audit_events(spark, sf_dir, streaming))


def poisoned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records with every kind of undecodable value mixed in."""
    which = F.col("seq") % 40
    value = (
        F.when(which == 1, F.lit("not json"))
        .when(which == 2, F.expr("substring(value, 1, length(value) - 5)"))
        .when(which == 3, F.regexp_replace("value", '"type":"[A-Z_]+"', '"type":"BOGUS"'))
        .when(which == 4, F.regexp_replace("value", '"eventId":"evt-', '"eventIdent":"evt-'))
        .when(which == 5, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"yesterday"'))
        .when(which == 6, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":1704067200.250000000'))
        .when(which == 7, F.regexp_replace("value", '"riskLevel":("[A-Z]+"|null),', ""))
        .when(which == 8, F.regexp_replace("value", '"customerId":"[^"]*"', '"customerId":null'))
        .when(which == 9, F.regexp_replace("value", '"anomalous":false', '"anomalous":{}'))
        .otherwise(F.col("value"))
    )
    return raw_records(spark, sf_dir).withColumn("value", value)


def requests(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Wire requests, some of them invalid."""
    which = F.col("event_id") % 50
    base = table(spark, sf_dir, "events", streaming)
    return base.select(
        F.col("event_id").alias("seq"),
        F.when(which == 1, F.lit("  ")).otherwise(F.concat(F.lit("evt-"), _text("event_id"))).alias("eventId"),
        F.when(which != 2, F.concat(F.lit("cust-"), _text(F.col("user_id") % 5))).alias("customerId"),
        F.when(which == 3, F.lit("BOGUS"))
        .when(which != 4, F.when(F.col("event_type") == "purchase", F.lit("DATA_EXPORT")).otherwise(F.lit("API_CALL")))
        .alias("type"),
        F.when(which == 5, F.repeat(F.lit("r"), 600)).otherwise(F.lit("stock_register")).alias("resource"),
    )


def general_log(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """A database query log, one row per order."""
    key, cust = F.col("o_orderkey"), _text("o_custkey")
    which, user = key % 12, F.col("o_custkey") % 11
    argument = (
        F.when(which == 0, F.lit("SET autocommit=1"))
        .when(which == 1, F.lit("SHOW VARIABLES"))
        .when(which == 2, F.lit("select @@session.tx_isolation"))
        .when(which == 3, F.lit("SELECT MAX(event_time) FROM mysql.general_log"))
        .when(which == 4, F.lit("SELECT * FROM information_schema.tables"))
        .when(which == 5, F.lit("  "))
        .when(which == 6, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), _text(key), F.lit(" AND note = 'D''Arcy "), cust, F.lit("'")))
        .when(which == 7, F.concat(F.lit("  UPDATE table2 SET total = "), _text("o_totalprice"), F.lit(',  status = "'), F.col("o_orderstatus"), F.lit('" WHERE id='), cust, F.lit(" ")))
        .when(which == 8, F.concat(F.lit("INSERT INTO t1 (email, phone) VALUES ('u"), cust, F.lit("@example.com', '0151 77 2043')")))
        .when(which == 9, F.lit("COMMIT"))
        .when(which == 10, F.concat(F.lit("DELETE FROM c"), cust, F.lit(" WHERE a = 1e10 AND b = 'open")))
    )
    return table(spark, sf_dir, "orders", streaming).select(
        key.alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.when(user == 1, F.lit("plainuser"))
        .when(user != 0, F.concat(F.lit("u"), _text(F.col("o_custkey") % 40), F.lit("[u] @ localhost [127.0.0.1]")))
        .alias("user_host"),
        F.col("o_custkey").alias("thread_id"),
        F.when(key % 13 == 0, F.lit("Connect")).when(key % 13 == 1, F.lit("Execute")).otherwise(F.lit("Query")).alias("command_type"),
        argument.alias("argument"),
    )


def crm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second database's log, one row per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.to_timestamp(F.lit("2024-03-01T12:00:00Z")).alias("event_time"),
        F.lit("crm[crm] @ app [10.0.0.9]").alias("user_host"),
        F.col("c_custkey").alias("thread_id"),
        F.lit("Query").alias("command_type"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("USE crm"))
        .otherwise(F.concat(F.lit("SELECT name FROM client WHERE name = '"), F.col("c_name"), F.lit("'")))
        .alias("argument"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        audit_events(spark, sf_dir)
        .where(F.col("userId").isNotNull())
        .select(F.col("userId").alias("user_id"), F.col("customerId").alias("customer_id"))
        .distinct()
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenants on file: all that send events but one."""
    return (
        audit_events(spark, sf_dir)
        .select(F.col("customerId").alias("customer_id"))
        .distinct()
        .where(F.col("customer_id") != "cust-4")
    )
