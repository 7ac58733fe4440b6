"""Record schemas and the fixed value domains they draw on.

Every source is read with one of these schemas; nothing is inferred.  Event
columns keep the camelCase names of the public JSON contract, the relational
metadata table keeps its snake_case column names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
EVENT_TYPES = (
    "DATABASE_QUERY",
    "API_CALL",
    "AUTH_EVENT",
    "FILE_ACCESS",
    "PERMISSION_CHANGE",
    "DATA_EXPORT",
)

# Ordered from least to most severe; the position is the rank.
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

USER_CONTEXT_TAG = "enrichment.userContext"

# (event type, control id, framework, control name), in listing order per type
CONTROL_MAP = (
    ("DATABASE_QUERY", "AC-2", "SOC2", "Account Management"),
    ("API_CALL", "AC-2", "SOC2", "Account Management"),
    ("AUTH_EVENT", "AC-2", "SOC2", "Account Management"),
    ("AUTH_EVENT", "IA-2", "SOC2", "Identification and Authentication"),
    ("FILE_ACCESS", "AU-2", "SOC2", "Audit Events"),
    ("PERMISSION_CHANGE", "AC-6", "SOC2", "Least Privilege"),
    ("DATA_EXPORT", "AU-2", "SOC2", "Audit Events"),
    ("DATA_EXPORT", "Art-30", "GDPR", "Records of Processing Activities"),
)

REPORT_TITLES = {
    "SOC2": "SOC 2 Evidence Report",
    "GDPR": "GDPR Records of Processing Report",
    "HIPAA": "HIPAA Audit Controls Report",
}

CHANNELS = ("slack", "email")

# Relational tables: column -> (nullable, maximum length or None)
TABLES = {
    "customers": {
        "customer_id": (False, 64),
        "name": (False, 255),
        "created_at": (False, None),
    },
    "users": {
        "user_id": (False, 64),
        "customer_id": (False, 64),
        "email": (True, 255),
        "created_at": (False, None),
    },
    "audit_events": {
        "event_id": (False, 64),
        "customer_id": (False, 64),
        "user_id": (True, 64),
        "session_id": (True, 64),
        "occurred_at": (False, None),
        "event_type": (False, 32),
        "resource": (True, 512),
        "action": (True, 128),
        "risk_level": (True, 16),
        "anomalous": (False, None),
    },
    "compliance_controls": {
        "control_id": (False, 32),
        "framework": (False, 32),
        "name": (False, 255),
        "description": (True, None),
    },
    "alert_rules": {
        "rule_id": (False, 64),
        "customer_id": (False, 64),
        "name": (False, 255),
        "event_type": (True, 32),
        "risk_threshold": (True, 16),
        "condition_expression": (True, None),
        "enabled": (False, None),
    },
    "alert_history": {
        "alert_id": (False, 64),
        "rule_id": (False, 64),
        "event_id": (False, 64),
        "customer_id": (False, 64),
        "triggered_at": (False, None),
        "notified_channels": (True, 255),
    },
}
PRIMARY_KEYS = {
    "customers": ("customer_id",),
    "users": ("user_id",),
    "audit_events": ("event_id",),
    "compliance_controls": ("control_id", "framework"),
    "alert_rules": ("rule_id",),
    "alert_history": ("alert_id",),
}
# child table -> (column, parent table)
FOREIGN_KEYS = {
    "users": ("customer_id", "customers"),
    "alert_history": ("rule_id", "alert_rules"),
}
# ----------------------------------------------------------------------------


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CONTROL = T.StructType(
    _strings("controlId", "framework", "name", "description")
    + [
        T.StructField("evidenceTypes", T.ArrayType(T.StringType())),
        T.StructField("queryPatterns", T.ArrayType(T.StringType())),
    ]
)

_EVENT_HEAD = _strings("eventId", "customerId", "userId", "sessionId")
_EVENT_TAIL = (
    _strings("type", "resource", "action", "query", "ipAddress", "userAgent", "location")
    + [T.StructField("controls", T.ArrayType(CONTROL))]
    + _strings("riskLevel")
    + [
        T.StructField("anomalous", T.BooleanType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
    + _strings("rawLog")
)

AUDIT_EVENT = T.StructType(
    _EVENT_HEAD + [T.StructField("timestamp", T.TimestampType())] + _EVENT_TAIL
)
EVENT_COLUMNS = AUDIT_EVENT.fieldNames()

CORRUPT = "_corrupt_record"

# As it travels: the instant is text (ISO or epoch seconds) until parsed.
AUDIT_EVENT_WIRE = T.StructType(
    _EVENT_HEAD
    + [T.StructField("timestamp", T.StringType())]
    + _EVENT_TAIL
    + [T.StructField(CORRUPT, T.StringType())]
)

REQUEST = T.StructType(
    _strings(
        "eventId", "customerId", "userId", "sessionId", "type", "resource",
        "action", "query", "ipAddress", "userAgent", "rawLog",
    )
)

ALERT_RULE = T.StructType(
    _strings(
        "ruleId", "customerId", "name", "description", "eventType",
        "riskThreshold", "conditionExpression",
    )
    + [
        T.StructField("enabled", T.BooleanType()),
        T.StructField("notificationChannels", T.ArrayType(T.StringType())),
    ]
)

GENERAL_LOG = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("user_host", T.StringType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("command_type", T.StringType()),
        T.StructField("argument", T.StringType()),
    ]
)

METADATA = T.StructType(
    _strings("event_id", "customer_id", "user_id", "session_id")
    + [T.StructField("occurred_at", T.TimestampType())]
    + _strings("event_type", "resource", "action", "risk_level")
    + [T.StructField("anomalous", T.BooleanType())]
)

ALERT = T.StructType(
    _strings("alert_id", "rule_id", "event_id", "customer_id")
    + [T.StructField("triggered_at", T.TimestampType())]
    + _strings("channel")
    + [T.StructField("channel_pos", T.IntegerType())]
    + _strings("subject", "body", "payload", "status")
)
