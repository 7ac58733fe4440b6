"""Alert wording, shared by all channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailwarden.functions.text import iso_instant

DEFAULT_TAG = "Trailwarden"
UNRATED = "unrated"


def _or_dash(value: Column) -> Column:
    return F.coalesce(value, F.lit("-"))


def _label(rule_name: Column, rule_id: Column) -> Column:
    return F.coalesce(rule_name, rule_id)


def alert_subject(tag: str = DEFAULT_TAG) -> Column:
    """Subject line over a joined (event, rule) row; the product tag is a setting."""
    return F.concat(
        F.lit(f"[{tag}] "),
        _label(F.col("ruleName"), F.col("ruleId")),
        F.lit(" - "),
        F.coalesce(F.col("riskLevel"), F.lit(UNRATED)),
        F.lit(" risk for "),
        F.col("ruleCustomerId"),
    )


def alert_body() -> Column:
    """Six-line body over a joined (event, rule) row."""
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Rule: "), _label(F.col("ruleName"), F.col("ruleId")),
            F.lit(" ("), F.col("ruleId"), F.lit(")"),
        ),
        F.concat(F.lit("Customer: "), F.col("ruleCustomerId")),
        F.concat(
            F.lit("Event: "), F.coalesce(F.col("type"), F.lit("null")), F.lit(" "),
            _or_dash(F.col("action")), F.lit(" on "), _or_dash(F.col("resource")),
        ),
        F.concat(
            F.lit("User: "), _or_dash(F.col("userId")), F.lit(" from "),
            _or_dash(F.col("ipAddress")),
        ),
        F.concat(
            F.lit("Risk: "), F.coalesce(F.col("riskLevel"), F.lit(UNRATED)),
            F.when(F.col("anomalous"), F.lit(" (anomalous)")).otherwise(F.lit("")),
        ),
        F.concat(
            F.lit("Event id: "), F.col("eventId"), F.lit(" at "),
            F.coalesce(iso_instant(F.col("timestamp")), F.lit("null")),
        ),
    )


def slack_payload(subject: Column, body: Column) -> Column:
    """Webhook document: bold subject, fenced body."""
    text = F.concat(F.lit("*"), subject, F.lit("*\n```"), body, F.lit("```"))
    return F.to_json(F.struct(text.alias("text")))


def email_payload(subject: Column, body: Column) -> Column:
    return F.to_json(F.struct(subject.alias("subject"), body.alias("body")))


# channel -> payload builder; the keys are the channels that can be delivered
CHANNEL_PAYLOADS = {"slack": slack_payload, "email": email_payload}


def channel_payload(channel: Column, subject: Column, body: Column, renderers=None) -> Column:
    """Payload of the row's own channel."""
    payload = F.lit(None).cast("string")
    for name, render in (renderers or CHANNEL_PAYLOADS).items():
        payload = F.when(channel == name, render(subject, body)).otherwise(payload)
    return payload
