"""Plain-SQL twins of the catalog, written independently of the operators.

They run on any engine with the given tables registered as views; the dialect
is that of an embedded analytical SQL engine.
"""

from __future__ import annotations


def iso(ts: str) -> str:
    full = f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"
    return (
        f"CASE WHEN {full} LIKE '%.000000' THEN left({full}, 19) || 'Z' "
        f"WHEN {full} LIKE '%000' THEN left({full}, 23) || 'Z' ELSE {full} || 'Z' END"
    )


_AUDIT_RAW = """
audit_raw AS (
  SELECT event_id AS seq,
    concat('evt-', CAST(event_id AS VARCHAR)) AS event_id,
    concat('cust-', CAST(user_id % 5 AS VARCHAR)) AS customer_id,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('user-', CAST(user_id AS VARCHAR)) END AS user_id,
    concat('sess-', CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_id,
    ts,
    CASE event_type WHEN 'view' THEN 'FILE_ACCESS' WHEN 'signup' THEN 'AUTH_EVENT'
      WHEN 'error' THEN 'PERMISSION_CHANGE' WHEN 'purchase' THEN 'DATA_EXPORT'
      ELSE CASE WHEN k < 50 THEN 'DATABASE_QUERY' ELSE 'API_CALL' END END AS type,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 3 = 0 THEN 'client_register' WHEN k % 3 = 1 THEN 'stock_register'
      ELSE concat('profile:', CAST(user_id AS VARCHAR)) END AS resource,
    CASE event_type WHEN 'view' THEN 'PROFILE_VIEW'
      WHEN 'signup' THEN CASE WHEN k < 30 THEN 'BADGE_REFUSED' ELSE 'BADGE_ACCEPTED' END
      WHEN 'error' THEN 'GRANT' WHEN 'purchase' THEN 'EXPORT'
      ELSE CASE WHEN k < 50 THEN 'SELECT' ELSE 'GET' END END AS action,
    CASE WHEN event_type = 'click' AND k < 50
      THEN concat('SELECT * FROM customers WHERE id = ', CAST(user_id AS VARCHAR)) END AS query,
    CASE WHEN k % 4 = 0 THEN concat('10.0.0.', CAST(k AS VARCHAR)) WHEN k % 4 = 1 THEN NULL
      ELSE concat('203.0.113.', CAST(k AS VARCHAR)) END AS ip_address,
    CASE WHEN k = 99 THEN NULL WHEN value < 15 THEN 'LOW' WHEN value < 70 THEN 'MEDIUM'
      WHEN value < 110 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
    CASE WHEN k % 7 = 0 THEN 'preset' END AS preset
  FROM (SELECT *, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) AS k FROM events) e
)"""

_CONTROLS = """
control_map(type, pos, control_id, framework, name) AS (VALUES
  ('DATABASE_QUERY', 0, 'AC-2', 'SOC2', 'Account Management'),
  ('API_CALL', 0, 'AC-2', 'SOC2', 'Account Management'),
  ('AUTH_EVENT', 0, 'AC-2', 'SOC2', 'Account Management'),
  ('AUTH_EVENT', 1, 'IA-2', 'SOC2', 'Identification and Authentication'),
  ('FILE_ACCESS', 0, 'AU-2', 'SOC2', 'Audit Events'),
  ('PERMISSION_CHANGE', 0, 'AC-6', 'SOC2', 'Least Privilege'),
  ('DATA_EXPORT', 0, 'AU-2', 'SOC2', 'Audit Events'),
  ('DATA_EXPORT', 1, 'Art-30', 'GDPR', 'Records of Processing Activities')),
type_controls AS (
  SELECT type, string_agg(control_id || '/' || framework || '/' || name, ';' ORDER BY pos) AS controls,
    '[' || string_agg('{"controlId":"' || control_id || '","framework":"' || framework || '","name":"' || name ||
      '","description":null,"evidenceTypes":[],"queryPatterns":[]}', ',' ORDER BY pos) || ']' AS controls_json
  FROM control_map GROUP BY type)"""

_FLAGGED = "(type = 'DATA_EXPORT' OR (type = 'PERMISSION_CHANGE' AND coalesce(risk_level = 'CRITICAL', false)))"


def _enriched(source: str = "audit_raw", name: str = "enriched") -> str:
    return f"""
{name} AS (
  SELECT r.* EXCLUDE (risk_level, preset),
    {_FLAGGED} AS anomalous,
    CASE WHEN {_FLAGGED} THEN 'HIGH' ELSE risk_level END AS risk_level,
    coalesce(c.controls, '') AS controls, coalesce(c.controls_json, '[]') AS controls_json,
    '{{"enrichment.userContext":"' || coalesce(preset, CASE WHEN user_id IS NULL THEN 'unknown' ELSE 'resolved' END) || '"}}' AS tags
  FROM (SELECT * FROM {source}) r LEFT JOIN type_controls c USING (type))"""


_REPLAYED = """
replayed AS (
  SELECT * FROM audit_raw
  UNION ALL SELECT * REPLACE (seq + 10000000000 AS seq) FROM audit_raw WHERE seq % 10 = 0
  UNION ALL SELECT * REPLACE (seq + 20000000000 AS seq, 'cust-x' AS customer_id, 'CRITICAL' AS risk_level)
    FROM audit_raw WHERE seq % 25 = 0
)"""

_METADATA = f"""
metadata AS (
  SELECT seq, event_id, customer_id, user_id, session_id, ts AS occurred_at, type AS event_type, resource, action,
    CASE WHEN {_FLAGGED} THEN 'HIGH' ELSE risk_level END AS risk_level, {_FLAGGED} AS anomalous
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS rn FROM replayed) WHERE rn = 1)"""

_REQUESTS = """
requests AS (
  SELECT event_id AS seq,
    CASE WHEN event_id % 50 = 1 THEN '  ' ELSE concat('evt-', CAST(event_id AS VARCHAR)) END AS event_id,
    CASE WHEN event_id % 50 = 2 THEN NULL ELSE concat('cust-', CAST(user_id % 5 AS VARCHAR)) END AS customer_id,
    CASE WHEN event_id % 50 = 3 THEN 'BOGUS' WHEN event_id % 50 = 4 THEN NULL
      WHEN event_type = 'purchase' THEN 'DATA_EXPORT' ELSE 'API_CALL' END AS type,
    CASE WHEN event_id % 50 = 5 THEN repeat('r', 600) ELSE 'stock_register' END AS resource
  FROM events),
checked AS (
  SELECT *, CASE WHEN coalesce(trim(event_id), '') = '' THEN 'eventId is required'
    WHEN coalesce(trim(customer_id), '') = '' THEN 'customerId is required'
    WHEN type IS NULL THEN 'type is required'
    WHEN type NOT IN ('DATABASE_QUERY','API_CALL','AUTH_EVENT','FILE_ACCESS','PERMISSION_CHANGE','DATA_EXPORT')
      THEN 'invalid type' END AS reject_reason
  FROM requests)"""

_LOG = """
general_log AS (
  SELECT o_orderkey AS seq, o_orderdate AS event_time,
    CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 11 = 1 THEN 'plainuser'
      ELSE concat('u', CAST(o_custkey % 40 AS VARCHAR), '[u] @ localhost [127.0.0.1]') END AS user_host,
    o_custkey AS thread_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Connect' WHEN o_orderkey % 13 = 1 THEN 'Execute' ELSE 'Query' END AS command_type,
    CASE CAST(o_orderkey % 12 AS INT)
      WHEN 0 THEN 'SET autocommit=1' WHEN 1 THEN 'SHOW VARIABLES' WHEN 2 THEN 'select @@session.tx_isolation'
      WHEN 3 THEN 'SELECT MAX(event_time) FROM mysql.general_log' WHEN 4 THEN 'SELECT * FROM information_schema.tables'
      WHEN 5 THEN '  '
      WHEN 6 THEN concat('SELECT * FROM orders WHERE o_orderkey = ', CAST(o_orderkey AS VARCHAR), ' AND note = ''D''''Arcy ', CAST(o_custkey AS VARCHAR), '''')
      WHEN 7 THEN concat('  UPDATE table2 SET total = ', CAST(o_totalprice AS VARCHAR), ',  status = "', o_orderstatus, '" WHERE id=', CAST(o_custkey AS VARCHAR), ' ')
      WHEN 8 THEN concat('INSERT INTO t1 (email, phone) VALUES (''u', CAST(o_custkey AS VARCHAR), '@example.com'', ''0151 77 2043'')')
      WHEN 9 THEN 'COMMIT'
      WHEN 10 THEN concat('DELETE FROM c', CAST(o_custkey AS VARCHAR), ' WHERE a = 1e10 AND b = ''open')
      ELSE NULL END AS argument
  FROM orders)"""

_REDACT_NUMBERS = r"(^|[^\p{L}\p{Nd}_$])\p{Nd}[\p{Nd}.]*"
_REDACT_QUOTED = (
    r"""'(?:\\(?s:.)|''|[^'\\])*(?:'|\\?\z)|"(?:\\(?s:.)|""|[^"\\])*(?:"|\\?\z)"""
)


def redacted(text: str) -> str:
    quoted = _REDACT_QUOTED.replace("'", "''")
    masked = f"regexp_replace({text}, '{quoted}', '?', 'g')"
    masked = f"regexp_replace({masked}, '{_REDACT_NUMBERS}', '\\1?', 'g')"
    spaced = f"trim(regexp_replace({masked}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({spaced}) > 500 THEN left({spaced}, 500) || '…' ELSE {spaced} END"


def _log_events(source: str = "general_log", tenant: str = "acme", resource: str = "acme-mysql", name: str = "log_events") -> str:
    identity = f"{iso('event_time')} || '|' || CAST(thread_id AS VARCHAR) || '|' || stmt"
    return f"""
{name} AS (
  SELECT seq, 'mysql-' || left(sha256({identity}), 32) AS event_id, '{tenant}' AS customer_id,
    CASE WHEN coalesce(trim(user_host), '') = '' THEN 'unknown'
      WHEN strpos(user_host, '[') > 1 THEN trim(split_part(user_host, '[', 1)) ELSE trim(user_host) END AS user_id,
    event_time, 'DATABASE_QUERY' AS type, '{resource}' AS resource, upper(split_part(stmt, ' ', 1)) AS action,
    {redacted('stmt')} AS query
  FROM (SELECT *, trim(coalesce(argument, '')) AS stmt FROM {source} WHERE command_type IN ('Query', 'Execute'))
  WHERE stmt <> '' AND NOT regexp_matches(lower(stmt), 'general_log|information_schema|performance_schema|@@|^set |^show |^use '))"""


def _json_event(time: str = "ts", controls: str = "'[]'", risk: str = "risk_level", anomalous: str = "'false'", tags: str = "") -> str:
    def text(column: str) -> str:
        return f"coalesce('\"' || {column} || '\"', 'null')"

    parts = [
        ("eventId", text("event_id")), ("customerId", text("customer_id")), ("userId", text("user_id")),
        ("sessionId", text("session_id")), ("timestamp", f"'\"' || {iso(time)} || '\"'"), ("type", text("type")),
        ("resource", text("resource")), ("action", text("action")), ("query", text("query")),
        ("ipAddress", text("ip_address")), ("userAgent", "'null'"), ("location", "'null'"),
        ("controls", controls), ("riskLevel", text(risk)), ("anomalous", anomalous),
        ("tags", tags or "coalesce('{\"enrichment.userContext\":\"' || preset || '\"}', '{}')"), ("rawLog", "'null'"),
    ]
    joined = " || ',' || ".join(f"'\"{k}\":' || ({v})" for k, v in parts)
    return f"'{{' || {joined} || '}}'"


_ENRICHED_JSON = _json_event(controls="controls_json", anomalous="CAST(anomalous AS VARCHAR)", tags="tags")

_RULES = """
rules(rule_id, tenant, name, event_type, min_rank, channels) AS (VALUES
  ('r01', 'cust-0', 'Badge refused', 'AUTH_EVENT', -1, ['slack']),
  ('r02', 'cust-1', 'Rated file touched', 'FILE_ACCESS', 1, ['slack', 'email']),
  ('r03', 'cust-2', 'Strange table read', NULL, -1, ['email']),
  ('r04', 'cust-2', NULL, 'DATA_EXPORT', 3, ['slack']),
  ('r05', 'cust-3', NULL, NULL, 0, ['pager', 'slack']),
  ('r07', 'cust-4', 'Client register or strange', NULL, -1, ['email']),
  ('r08', 'cust-4', 'Inside address', NULL, -1, ['slack']),
  ('r11', 'cust-0', 'High "risk"', NULL, 2, ['email', 'email']),
  ('r12', 'cust-9', NULL, NULL, -1, ['slack'])),
matches AS (
  SELECT r.rule_id, r.tenant, coalesce(r.name, r.rule_id) AS label, r.channels, e.*
  FROM enriched e JOIN rules r ON e.customer_id = r.tenant
  WHERE (r.event_type IS NULL OR r.event_type = e.type)
    AND coalesce(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], e.risk_level), 0) - 1 >= r.min_rank
    AND CASE r.rule_id
      WHEN 'r01' THEN coalesce(action = 'BADGE_REFUSED', false)
      WHEN 'r03' THEN anomalous AND coalesce(resource = 'client_register', false)
      WHEN 'r07' THEN resource IS NOT NULL AND (contains(resource, 'client') OR anomalous)
      WHEN 'r08' THEN ip_address IS NOT NULL AND NOT starts_with(ip_address, '203.0.')
      ELSE true END)"""

_ALERTS = f"""
channel_rows AS (
  SELECT m.*, pos - 1 AS channel_pos, channels[pos] AS channel
  FROM matches m, LATERAL (SELECT unnest(range(1, len(m.channels) + 1)) AS pos)),
texts AS (
  SELECT *, '[Trailwarden] ' || label || ' - ' || coalesce(risk_level, 'unrated') || ' risk for ' || tenant AS subject,
    'Rule: ' || label || ' (' || rule_id || ')' || chr(10) || 'Customer: ' || tenant || chr(10)
    || 'Event: ' || type || ' ' || coalesce(action, '-') || ' on ' || coalesce(resource, '-') || chr(10)
    || 'User: ' || coalesce(user_id, '-') || ' from ' || coalesce(ip_address, '-') || chr(10)
    || 'Risk: ' || coalesce(risk_level, 'unrated') || CASE WHEN anomalous THEN ' (anomalous)' ELSE '' END || chr(10)
    || 'Event id: ' || event_id || ' at ' || {iso('ts')} AS body
  FROM channel_rows WHERE channel IN ('slack', 'email')),
alerts AS (
  SELECT left(sha256(rule_id || '|' || tenant || '|' || event_id || '|' || CAST(channel_pos AS VARCHAR)), 32) AS alert_id,
    rule_id, event_id, tenant AS customer_id, {iso('ts')} AS triggered_at, channel, CAST(channel_pos AS INT) AS channel_pos,
    subject, body,
    CASE channel WHEN 'slack' THEN CAST(json_object('text', '*' || subject || '*' || chr(10) || '```' || body || '```') AS VARCHAR)
      ELSE CAST(json_object('subject', subject, 'body', body) AS VARCHAR) END AS payload,
    'pending' AS status
  FROM texts)"""

_WINDOW = """
evidence_window AS (
  SELECT * FROM enriched WHERE customer_id = 'cust-1'
    AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59')"""

_REPORT_ROWS = """
framework_rows AS (
  SELECT e.*, c.framework, 
    e.event_id || ' | ' || e.type || ' | controls=' || c.ids || ' | risk=' || coalesce(e.risk_level, 'null') AS line
  FROM {source} e JOIN (
    SELECT type, framework, string_agg(control_id, ',' ORDER BY pos) AS ids FROM control_map GROUP BY type, framework
  ) c USING (type))"""

_CUTOFF = "TIMESTAMP '2024-01-11 00:00:00'"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


_FLAT = (
    f"event_id, customer_id, user_id, session_id, {iso('ts')} AS ts, type, resource, action, query, ip_address, "
    "risk_level, anomalous, controls, tags"
)
_FLAT_METADATA = (
    f"event_id, customer_id, user_id, session_id, {iso('occurred_at')} AS occurred_at, event_type, resource, action, "
    "risk_level, anomalous"
)
_FLAT_ALERTS = "alert_id, rule_id, event_id, customer_id, triggered_at, channel, channel_pos, subject, body, payload, status"
_LOG_FLAT = f"seq, event_id, customer_id, user_id, {iso('event_time')} AS ts, type, resource, action, query"

_POISONED = f"""
poisoned AS (
  SELECT *, seq % 40 AS which,
    CASE WHEN seq % 40 = 1 THEN 'not json'
      WHEN seq % 40 = 2 THEN left(value, length(value) - 5)
      WHEN seq % 40 = 3 THEN regexp_replace(value, '"type":"[A-Z_]+"', '"type":"BOGUS"')
      WHEN seq % 40 = 4 THEN replace(value, '"eventId":"evt-', '"eventIdent":"evt-')
      WHEN seq % 40 = 5 THEN regexp_replace(value, '"timestamp":"[^"]*"', '"timestamp":"yesterday"')
      WHEN seq % 40 = 8 THEN regexp_replace(value, '"customerId":"[^"]*"', '"customerId":null')
      WHEN seq % 40 = 9 THEN replace(value, '"anomalous":false', '"anomalous":{{}}')
      ELSE value END AS sent
  FROM (SELECT *, {_json_event()} AS value FROM audit_raw))"""


def _metadata_rows(where: str = "") -> str:
    return f"SELECT {_FLAT_METADATA} FROM metadata {where}"


def _report(framework: str) -> str:
    return (
        _with(_AUDIT_RAW, _CONTROLS, _enriched(), _WINDOW, _REPORT_ROWS.format(source="evidence_window"))
        + f"SELECT framework, event_id, {iso('ts')} AS event_time, line FROM framework_rows WHERE framework = '{framework}'"
    )


_ENRICHED = (_AUDIT_RAW, _CONTROLS, _enriched())
_MATCHED = (*_ENRICHED, _RULES)
_STORED = (_AUDIT_RAW, _REPLAYED, _METADATA)
_LOG_ENRICHED = """
log_metadata AS (
  SELECT DISTINCT event_id, customer_id, user_id, CAST(NULL AS VARCHAR) AS session_id, event_time AS occurred_at,
    type AS event_type, resource, action, 'LOW' AS risk_level, false AS anomalous FROM log_events)"""


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["ingest_requests"] = (
        _with(_REQUESTS)
        + "SELECT seq, event_id, customer_id, type, resource, '2026-01-01T00:00:00Z' AS ts, 'LOW' AS risk_level, "
        "false AS anomalous, '' AS controls, '{}' AS tags FROM checked WHERE reject_reason IS NULL"
    )
    sql["ingest_rejects"] = _with(_REQUESTS) + "SELECT seq, event_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL"
    flat_poisoned = _FLAT.replace(
        "tags", "coalesce('{\"enrichment.userContext\":\"' || preset || '\"}', '{}') AS tags"
    ).replace("controls", "'' AS controls").replace("anomalous", "false AS anomalous")
    sql["parse_events"] = (
        _with(_AUDIT_RAW, _POISONED)
        + f"""SELECT {flat_poisoned} FROM (
  SELECT * REPLACE (CASE WHEN which = 6 THEN TIMESTAMP '2024-01-01 00:00:00.25' ELSE ts END AS ts,
    CASE WHEN which = 7 THEN 'LOW' ELSE risk_level END AS risk_level)
  FROM poisoned WHERE which NOT IN (1, 2, 3, 4, 5, 8, 9))"""
    )
    sql["corrupt_records"] = (
        _with(_AUDIT_RAW, _POISONED)
        + """SELECT seq, customer_id AS key, sent AS value, CASE
    WHEN which = 3 THEN 'invalid type' WHEN which = 4 THEN 'eventId is required' WHEN which = 5 THEN 'invalid timestamp'
    WHEN which = 8 THEN 'customerId is required' ELSE 'malformed json' END AS decode_error
  FROM poisoned WHERE which IN (1, 2, 3, 4, 5, 8, 9)"""
    )
    sql["topic_records"] = _with(_AUDIT_RAW) + f"SELECT seq, customer_id AS key, {_json_event()} AS value FROM audit_raw"

    sql["enrich_user_context"] = _with(*_ENRICHED) + "SELECT event_id, user_id, tags FROM enriched"
    sql["enrich_controls"] = _with(*_ENRICHED) + "SELECT event_id, type, controls FROM enriched"
    sql["enrich_anomaly"] = _with(*_ENRICHED) + "SELECT event_id, type, risk_level, anomalous FROM enriched"
    sql["enrich_all"] = _with(*_ENRICHED) + f"SELECT {_FLAT} FROM enriched"
    sql["enriched_records"] = _with(*_ENRICHED) + "SELECT seq, customer_id AS key, {} AS value FROM enriched".format(_ENRICHED_JSON)

    sql["rules_load"] = """
SELECT concat('nation-', CAST(c_nationkey AS VARCHAR)) AS customer_id, count(*) AS rule_count,
  sum(CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END)::BIGINT AS enabled_count,
  min(concat('rule-', CAST(c_custkey AS VARCHAR))) AS first_rule, max(concat('rule-', CAST(c_custkey AS VARCHAR))) AS last_rule
FROM customer GROUP BY c_nationkey"""
    sql["rule_matches"] = _with(*_MATCHED) + "SELECT rule_id, event_id, risk_level FROM matches"
    sql["rule_conditions"] = (
        _with(*_ENRICHED)
        + """SELECT 'r01' AS rule_id, event_id FROM enriched WHERE customer_id = 'cust-0' AND action = 'BADGE_REFUSED'
UNION ALL SELECT 'r03', event_id FROM enriched WHERE customer_id = 'cust-2' AND anomalous AND resource = 'client_register'
UNION ALL SELECT 'r07', event_id FROM enriched WHERE customer_id = 'cust-4' AND resource IS NOT NULL
  AND (resource LIKE '%client%' OR anomalous)
UNION ALL SELECT 'r08', event_id FROM enriched WHERE customer_id = 'cust-4' AND ip_address NOT LIKE '203.0.%'"""
    )
    sql["alert_dispatch"] = (
        _with(*_MATCHED)
        + """SELECT e.customer_id, e.event_id, coalesce(m.fired, 0)::BIGINT AS fired FROM enriched e LEFT JOIN (
  SELECT event_id, sum(len(list_filter(channels, lambda c: c IN ('slack', 'email')))) AS fired FROM matches GROUP BY event_id
) m USING (event_id)"""
    )
    sql["alert_unknown_channels"] = (
        _with(*_MATCHED, _ALERTS) + "SELECT rule_id, event_id, channel FROM channel_rows WHERE channel NOT IN ('slack', 'email')"
    )
    sql["alert_messages"] = _with(*_MATCHED, _ALERTS) + f"SELECT {_FLAT_ALERTS} FROM alerts"
    sql["alerts_end_to_end"] = (
        _with(*_MATCHED, _ALERTS) + "SELECT alert_id, rule_id, event_id, customer_id, channel, channel_pos, subject FROM alerts"
    )

    sql["evidence_latest"] = (
        _with(_AUDIT_RAW, _REPLAYED, _CONTROLS, _enriched("replayed"))
        + "SELECT seq, customer_id || '/' || event_id || '.json' AS evidence_key, {} AS document FROM ({})".format(
            _ENRICHED_JSON,
            "SELECT *, row_number() OVER (PARTITION BY customer_id, event_id ORDER BY seq DESC) AS rn FROM enriched",
        )
        + " WHERE rn = 1"
    )
    sql["metadata_insert"] = _with(*_STORED) + _metadata_rows("WHERE event_type <> 'AUTH_EVENT'")
    sql["metadata_violations"] = (
        _with(_REQUESTS)
        + "SELECT seq, event_id, 'resource' AS violated FROM checked WHERE reject_reason IS NULL AND length(resource) > 512"
    )
    sql["pk_duplicates"] = (
        _with(_AUDIT_RAW, _REPLAYED) + "SELECT event_id, count(*) AS copies FROM replayed GROUP BY event_id HAVING count(*) > 1"
    )
    sql["fk_orphans"] = (
        _with(_AUDIT_RAW)
        + """SELECT DISTINCT user_id, customer_id FROM audit_raw
WHERE user_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM audit_raw WHERE customer_id <> 'cust-4')"""
    )
    sql["fanout_counts"] = (
        _with(_AUDIT_RAW, _REPLAYED, _CONTROLS, _enriched("replayed"), _RULES, _ALERTS)
        + """SELECT 'evidence' AS sink, count(DISTINCT customer_id || '/' || event_id) AS rows FROM enriched
UNION ALL SELECT 'metadata', count(DISTINCT event_id) FROM enriched
UNION ALL SELECT 'enriched', count(*) FROM enriched
UNION ALL SELECT 'alerts', count(*) FROM alerts
UNION ALL SELECT 'violations', 0"""
    )

    sql["evidence_query"] = (
        _with(*_ENRICHED, _WINDOW)
        + f"""SELECT event_id, customer_id, {iso('ts')} AS event_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_second,
  type, resource, action, risk_level, anomalous, controls FROM evidence_window ORDER BY ts, event_id"""
    )
    for framework in ("SOC2", "GDPR", "HIPAA"):
        sql[f"report_{framework.lower()}"] = _report(framework)
    sql["report_all_events"] = (
        _with(*_ENRICHED, _REPORT_ROWS.format(source="enriched")) + "SELECT framework, event_id, line FROM framework_rows"
    )
    sql["report_summary"] = (
        _with(*_ENRICHED, _WINDOW, _REPORT_ROWS.format(source="evidence_window"))
        + """SELECT f.framework, count(r.event_id) AS events
FROM (VALUES ('SOC2'), ('GDPR'), ('HIPAA')) f(framework) LEFT JOIN framework_rows r USING (framework) GROUP BY f.framework"""
    )
    sql["report_text"] = (
        _with(*_ENRICHED, _WINDOW, _REPORT_ROWS.format(source="evidence_window"))
        + f""", titles(framework, title) AS (VALUES ('SOC2', 'SOC 2 Evidence Report'), ('GDPR', 'GDPR Records of Processing Report'),
  ('HIPAA', 'HIPAA Audit Controls Report'))
SELECT framework, 0 AS part, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS event_time, title AS line FROM titles
UNION ALL SELECT framework, 1, NULL, NULL, 'Customer: cust-1' FROM titles
UNION ALL SELECT framework, 2, NULL, NULL, 'Period: 2024-01-10T00:00:00Z - 2024-01-20T23:59:59.900Z' FROM titles
UNION ALL SELECT t.framework, 3, NULL, NULL, 'Events: ' || CAST(count(r.event_id) AS VARCHAR)
  FROM titles t LEFT JOIN framework_rows r USING (framework) GROUP BY t.framework
UNION ALL SELECT framework, 4, event_id, {iso('ts')}, line FROM framework_rows"""
    )

    sql["log_collect"] = (
        _with(_LOG)
        + f"""SELECT seq, {iso('event_time')} AS event_time, user_host, thread_id, command_type, argument FROM general_log
WHERE event_time > TIMESTAMP '1995-01-01 00:00:00' AND command_type IN ('Query', 'Execute')
ORDER BY general_log.event_time, thread_id, argument NULLS FIRST, seq LIMIT 500"""
    )
    sql["log_checkpoint"] = (
        _with(_LOG)
        + f""", unread AS (SELECT event_time FROM general_log
  WHERE event_time > TIMESTAMP '1995-01-01 00:00:00' AND command_type IN ('Query', 'Execute')),
last AS (SELECT max(event_time) AS t FROM (SELECT event_time FROM unread ORDER BY event_time LIMIT 500))
SELECT count(*) AS rows_read, {iso('max(event_time)')} AS mark, (SELECT {iso('max(event_time)')} FROM general_log) AS log_maximum
FROM unread WHERE event_time <= (SELECT t FROM last)"""
    )
    sql["log_noise"] = (
        _with(_LOG)
        + """SELECT seq, statement, CASE WHEN statement = '' THEN 'empty'
  WHEN lower(statement) LIKE '%general@_log%' ESCAPE '@' THEN 'general_log'
  WHEN lower(statement) LIKE '%information@_schema%' ESCAPE '@' THEN 'information_schema'
  WHEN lower(statement) LIKE '%performance@_schema%' ESCAPE '@' THEN 'performance_schema'
  WHEN strpos(statement, '@@') > 0 THEN '@@'
  WHEN lower(statement) LIKE 'set %' THEN 'set' WHEN lower(statement) LIKE 'show %' THEN 'show'
  WHEN lower(statement) LIKE 'use %' THEN 'use' END AS noise
FROM (SELECT seq, trim(coalesce(argument, '')) AS statement FROM general_log)"""
    )
    sql["log_events"] = _with(_LOG, _log_events()) + f"SELECT {_LOG_FLAT} FROM log_events"
    sql["redact_sql"] = _with(_LOG) + f"SELECT seq, {redacted('argument')} AS redacted FROM general_log"
    sql["agent_forward"] = (
        _with(_LOG, _log_events())
        + "SELECT seq, event_id, customer_id, user_id, '2026-01-01T00:00:00Z' AS ts, type, resource, action, query, "
        "'LOW' AS risk_level FROM log_events"
    )
    sql["collect_all"] = (
        _with(_LOG, _log_events())
        + """SELECT 'mysql-general-log:acme-mysql' AS source, count(*) AS collected, count(*) AS delivered FROM log_events
UNION ALL SELECT 'mysql-general-log:acme-crm', count(*), count(*) FROM customer WHERE c_mktsegment <> 'MACHINERY'"""
    )
    sql["log_replay_dedupe"] = (
        _with(_LOG, _log_events()) + f"SELECT DISTINCT event_id, user_id, {iso('event_time')} AS ts, action, query FROM log_events"
    )
    sql["log_to_metadata"] = _with(_LOG, _log_events(), _LOG_ENRICHED) + f"SELECT {_FLAT_METADATA} FROM log_metadata"

    past, current = f"WHERE occurred_at < {_CUTOFF}", f"WHERE occurred_at >= {_CUTOFF}"
    sql["retention_expired"] = (
        _with(*_STORED) + f"SELECT event_id, customer_id, {iso('occurred_at')} AS occurred_at, event_type FROM metadata {past}"
    )
    sql["retention_kept"] = _with(*_STORED) + _metadata_rows(current)
    sql["retention_one_statement"] = (
        _with(*_STORED)
        + f"""SELECT event_id, customer_id, {iso('occurred_at')} AS occurred_at FROM metadata WHERE event_id NOT IN (
  SELECT event_id FROM metadata {past} ORDER BY metadata.occurred_at, event_id LIMIT 1000)"""
    )
    sql["retention_summary"] = (
        _with(*_STORED) + f"SELECT count(*) AS deleted, (count(*) // 1000 + 1)::BIGINT AS statements FROM metadata {past}"
    )
    sql["retention_batches"] = (
        _with(*_STORED)
        + f"""SELECT event_id, {iso('occurred_at')} AS occurred_at, n AS row_index, n // 1000 AS batch FROM (
  SELECT event_id, occurred_at, row_number() OVER (ORDER BY occurred_at, event_id) - 1 AS n FROM metadata {past})"""
    )
    sql["iso_instants"] = (
        _with(_AUDIT_RAW)
        + f"""SELECT seq, {iso('ts')} AS micros, {iso("date_trunc('millisecond', ts)")} AS millis,
  {iso("date_trunc('second', ts)")} AS seconds FROM audit_raw"""
    )

    sql["stream_enrich"] = sql["enrich_all"]
    sql["stores_two_writers"] = (
        f"SELECT event_id, 1 AS metadata_rows, 1 AS evidence_rows FROM (SELECT event_id FROM ({sql['enrich_all']}) "
        f"UNION ALL SELECT event_id FROM ({sql['log_to_metadata']}))"
    )
    sql["rule_errors"] = (
        "SELECT concat('rule-', c_custkey) AS rule_id, c_custkey % 4 = 1 AS too_long FROM customer "
        "WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 4 IN (0, 1)"
    )
    sql["rule_matches_many"] = (
        _with(*_ENRICHED) + "SELECT concat('rule-', c_custkey) AS rule_id, event_id FROM enriched "
        "JOIN customer ON user_id = concat('user-', c_custkey) AND customer_id = concat('cust-', c_custkey % 5)"
    )
    sql["stream_alerts"] = sql["alert_messages"]
    sql["stream_log_collect"] = sql["log_to_metadata"]
    sql["stream_ingest"] = (
        _with(_REQUESTS)
        + "SELECT event_id, customer_id, type, resource, '2026-01-01T00:00:00Z' AS ts, 'LOW' AS risk_level, "
        "false AS anomalous FROM checked WHERE reject_reason IS NULL"
    )
    sql["stream_dedupe_recent"] = _with(_AUDIT_RAW) + "SELECT DISTINCT event_id FROM audit_raw"
    sql["stream_dedupe"] = _with(*_STORED) + _metadata_rows()
    sql["stream_insert_many"] = sql["stream_dedupe"]
    sql["purge_store"] = sql["retention_kept"]
    sql["compacted_store"] = (
        _with(_AUDIT_RAW, _REPLAYED)
        + "SELECT event_id, count(*) AS evidence_rows, count(*) AS version_rows, 1 AS metadata_rows FROM replayed GROUP BY event_id"
    )
    later = "SELECT * REPLACE (CASE WHEN seq % 7 = 0 THEN ts + INTERVAL 10 DAY ELSE ts END AS ts) FROM audit_raw"
    sql["evidence_store_window"] = sql["evidence_query"].replace("FROM (SELECT * FROM audit_raw) r", f"FROM ({later}) r")
    sql["agent_to_raw"] = sql["agent_forward"].replace("SELECT seq, event_id", "SELECT event_id")
    more = "UNION ALL SELECT event_id, type, risk_level, 'HIPAA', CASE type WHEN 'FILE_ACCESS' THEN 'own-0' ELSE 'own-1' END FROM audit_raw"
    sql["report_own_controls"] = (
        _with(_AUDIT_RAW, _CONTROLS)
        + f"""SELECT framework, event_id, event_id || ' | ' || type || ' | controls=' || ids || ' | risk=' || coalesce(risk_level, 'null') AS line
FROM (SELECT event_id, type, risk_level, framework, ids FROM audit_raw
  JOIN (SELECT type, framework, string_agg(control_id, ',' ORDER BY pos) AS ids FROM control_map GROUP BY ALL) USING (type)
  {more} WHERE type IN ('FILE_ACCESS', 'AUTH_EVENT'))"""
    )
    unread = "event_time > {0} AND command_type IN ('Query', 'Execute')"
    step = "{0} AS (SELECT max(event_time) AS t FROM (SELECT event_time FROM general_log WHERE {1} ORDER BY event_time LIMIT 500))"
    marks, before = [], "TIMESTAMP '1995-01-01 00:00:00'"
    for name in ("mark1", "mark2", "mark3"):
        marks.append(step.format(name, unread.format(before)))
        before = f"(SELECT t FROM {name})"
    read = f"log_read AS (SELECT * FROM general_log WHERE event_time > TIMESTAMP '1995-01-01 00:00:00' AND event_time <= {before})"
    sql["log_polls"] = (
        _with(_LOG, *marks, read, _log_events("log_read"), _LOG_ENRICHED)
        + f"SELECT {_FLAT_METADATA}, (SELECT {iso('t')} FROM mark3) AS mark, 3 AS moves FROM log_metadata"
    )
    return sql
