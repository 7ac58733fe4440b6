"""Events against tenant rules, and matches to deliverable alerts."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwarden.functions.messages import (
    CHANNEL_PAYLOADS,
    DEFAULT_TAG,
    alert_body,
    alert_subject,
    channel_payload,
)
from trailwarden.functions.risk import risk_ordinal, risk_rank
from trailwarden.functions.text import is_missing
from trailwarden.operators.conditions import MAX_LENGTH, PARAMETERS, ConditionSet, compile_all, lifted, rule_errors
from trailwarden.schemas import CHANNELS, EVENT_TYPES, RISK_LEVELS

# A prepared rule table is broadcast only below this measured size.
BROADCAST_RULE_BYTES = 64 * 1024 * 1024
# Slices of a tenant's events when the rule table is too big to broadcast.
TENANT_SLICES = 64
# A condition's own text becomes a join key where so many rules share its shape; with fewer the residual is cheaper.
KEYED_RULES = 1_000


def known_channels(channels: Column, known: tuple[str, ...] = CHANNELS) -> Column:
    return F.filter(channels, lambda c: c.isin(*known))


def active_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules under names that cannot clash with event columns."""
    enabled = F.coalesce(F.col("enabled"), F.lit(True))
    condition = F.when(~is_missing(F.col("conditionExpression")), F.col("conditionExpression"))
    return rules.where(enabled).select(
        F.col("ruleId"),
        F.col("customerId").alias("ruleCustomerId"),
        F.col("name").alias("ruleName"),
        F.col("eventType").alias("ruleEventType"),
        # a level that is not one of the four is above all of them: the rule never fires
        F.when(F.col("riskThreshold").isNull(), F.lit(-1))
        .otherwise(F.coalesce(risk_ordinal(F.col("riskThreshold")), F.lit(len(RISK_LEVELS))))
        .alias("ruleMinRank"),
        condition.alias("ruleCondition"),
        F.coalesce(F.col("notificationChannels"), F.array().cast("array<string>")).alias("ruleChannels"),
        lifted(condition).alias("_lifted"),
    ).select("*", "_lifted.*").drop("_lifted")


def condition_shapes(active: DataFrame) -> dict[str, int]:
    """The shapes of the conditions in use, which the driver compiles, and how many rules have each.

    Over-long ones can never match and stay out; ``rejected_rules`` lists them.
    """
    shapes = active.where(F.col("ruleShape").isNotNull()).groupBy("ruleShape").count()
    return dict(sorted(tuple(row) for row in shapes.collect()))


_EVERY_TYPE = ("", *EVENT_TYPES)  # the empty one stands for an event without type


def _keyed(active: DataFrame) -> DataFrame:
    """One row per (rule, key of events it can apply to): the text its condition asks for, or else each event type."""
    of_type = lambda t: F.concat(F.lit("type="), t)
    types = F.when(F.col("ruleEventType").isNull(), F.array(*[F.lit(t) for t in _EVERY_TYPE])).otherwise(F.array("ruleEventType"))
    text = F.concat("ruleKeyName", F.lit("="), F.get(PARAMETERS["s"], F.col("ruleKeyAt")))
    keys = F.when(F.col("ruleKeyName").isNull(), F.transform(types, of_type)).otherwise(F.array(text))
    return active.withColumn("ruleKey", F.explode(keys))


def _event_key(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(F.col(name), F.lit("")) if name == "type" else F.col(name))


def _numbered(active: DataFrame, conditions: ConditionSet, keys: dict[int, tuple[str, int]]) -> DataFrame:
    """Attach the number of each rule's condition, 0 for none, and its key; rejected ones go."""
    spark = active.sparkSession
    rows = []
    for shape, n in conditions.ids.items():
        if shape not in conditions.errors:
            name, at = keys.get(n, (None, None))
            rows.append({"ruleShape": shape, "n": n, "ruleKeyName": name, "ruleKeyAt": at})
    kinds = [("ruleShape", pa.string()), ("n", pa.int32()), ("ruleKeyName", pa.string()), ("ruleKeyAt", pa.int32())]
    table = pa.Table.from_pylist(rows, schema=pa.schema(kinds))
    lookup = F.broadcast(spark.createDataFrame(table))  # the shapes the driver has compiled
    joined = active.join(lookup, "ruleShape", "left")
    return joined.withColumn(
        "ruleConditionId", F.when(F.col("ruleCondition").isNull(), F.lit(0)).otherwise(F.col("n"))
    ).where(F.col("ruleConditionId").isNotNull()).drop("n")


def _fits_broadcast(rules: DataFrame) -> bool:
    width = F.sum(F.length(F.to_json(F.struct("*"))))
    usable = rules.where(F.col("ruleCondition").isNull() | (F.length("ruleCondition") <= MAX_LENGTH)).drop("ruleShape", *PARAMETERS.values())
    size = usable.agg(width.alias("bytes")).first()["bytes"] or 0
    return size * 2 * (len(EVENT_TYPES) + 1) <= BROADCAST_RULE_BYTES


def join_rules(
    events: DataFrame,
    active: DataFrame,
    conditions: ConditionSet,
    how: str = "inner",
    broadcast_rules: bool | None = None,
) -> DataFrame:
    """Event columns next to the columns of every rule that matches.

    Tenant and event type, or tenant and the text that a condition asks for, are
    equi-join keys, risk and the whole condition a residual. Rules small enough
    are broadcast, so a dominant tenant needs no shuffle at all; otherwise each
    tenant is cut into slices and its rules without a text are copied to each.
    """
    small = _fits_broadcast(active) if broadcast_rules is None else broadcast_rules
    keys = {n: c.key for n, c in conditions.compiled.items() if c.key and n in conditions.common} if how in ("inner", "left") else {}
    rules = _keyed(_numbered(active, conditions, keys))
    event_type = F.coalesce(F.col("type"), F.lit(""))
    on = (
        (F.col("customerId") == F.col("ruleCustomerId"))
        & (F.col("_key") == F.col("ruleKey"))
        & F.when(F.col("ruleEventType").isNull(), event_type.isin(*_EVERY_TYPE)).otherwise(event_type == F.col("ruleEventType"))
        & (risk_rank(F.col("riskLevel")) >= F.col("ruleMinRank"))
        & conditions.match(F.col("ruleConditionId"))
    )
    if small:
        rules = F.broadcast(rules)
    else:
        slices = F.sequence(F.lit(0), F.when(F.col("ruleKeyName").isNull(), F.lit(TENANT_SLICES - 1)).otherwise(F.lit(0)))
        rules = rules.withColumn("_ruleSlice", F.explode(slices))
        on = on & (F.col("_slice") == F.col("_ruleSlice"))
    own = ("_key", "_slice", "_ruleSlice", "ruleKey", "ruleEventType", "ruleKeyName", "ruleKeyAt", "ruleShape", *PARAMETERS.values())

    def met(events: DataFrame, names: list[str], how: str) -> DataFrame:
        found = F.array(*[_event_key(n) for n in names])
        key = F.explode(F.filter(found, lambda k: k.isNotNull())) if len(names) > 1 else _event_key(names[0])
        keyed = events.withColumn("_key", key)
        if not small:
            part = F.pmod(F.xxhash64("eventId"), F.lit(TENANT_SLICES)).cast("int")
            keyed = keyed.withColumn("_slice", F.when(F.startswith("_key", F.lit("type=")), part).otherwise(F.lit(0)))
        return keyed.join(rules, on, how).drop(*own)

    names = ["type", *sorted({name for name, _ in keys.values()})]
    if len(names) == 1 or how == "inner":
        return met(events, names, how)
    unmatched = events
    for name in names:
        unmatched = met(unmatched, [name], "left_anti")
    return met(events, names, "inner").unionByName(unmatched, allowMissingColumns=True)


@dataclass(frozen=True)
class PreparedRules:
    """A rule set as streams reuse it: compiled and measured once, not per batch."""

    active: DataFrame
    conditions: ConditionSet
    small: bool


def prepare_rules(rules: DataFrame) -> PreparedRules:
    active = active_rules(rules)
    return PreparedRules(active, _compiled(active), _fits_broadcast(active))


def _compiled(active: DataFrame) -> ConditionSet:
    shapes = condition_shapes(active)
    conditions = compile_all(active.sparkSession, list(shapes))
    conditions.common.update(n for shape, n in conditions.ids.items() if shapes[shape] >= KEYED_RULES)
    return conditions


def match_rules(
    events: DataFrame, rules: DataFrame | PreparedRules, how: str = "inner", broadcast_rules: bool | None = None
) -> DataFrame:
    """All (event, rule) matches; with ``how="left"`` unmatched events stay once.

    One join and one reading of the events, whatever the number of conditions.
    """
    prepared = rules if isinstance(rules, PreparedRules) else prepare_rules(rules)
    small = prepared.small if broadcast_rules is None else broadcast_rules
    return join_rules(events, prepared.active, prepared.conditions, how, small)


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules whose condition can never hold, with the reason."""
    return rule_errors(rules.where(F.coalesce(F.col("enabled"), F.lit(True))), _compiled(active_rules(rules)))


def match_conditions(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Only the condition part: rows where a rule's own condition holds.

    Tenant scope applies, the other criteria (enabled, type, risk) do not.
    """
    every = rules.withColumns(
        {
            "enabled": F.lit(True),
            "eventType": F.lit(None).cast("string"),
            "riskThreshold": F.lit(None).cast("string"),
        }
    ).where(~is_missing(F.col("conditionExpression")))
    return match_rules(events, every)


def explode_channels(matches: DataFrame) -> DataFrame:
    """One row per (rule, event, channel entry); a repeated channel repeats."""
    return matches.select("*", F.posexplode("ruleChannels").alias("channelPos", "channel")).drop("ruleChannels")


def deliverable(channel_rows: DataFrame, known: tuple[str, ...] = CHANNELS) -> DataFrame:
    return channel_rows.where(F.col("channel").isin(*known))


def undeliverable(channel_rows: DataFrame, known: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Channel entries nobody can deliver: skipped, but not silently."""
    return channel_rows.where(~F.coalesce(F.col("channel").isin(*known), F.lit(False)))


def dispatch_counts(events: DataFrame, rules: DataFrame, known: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Notifications attempted per event, 0 for events that match nothing."""
    deliverable_only = rules.withColumn("notificationChannels", known_channels(F.col("notificationChannels"), known))
    joined = match_rules(events, deliverable_only, how="left")
    attempts = F.coalesce(F.size("ruleChannels"), F.lit(0))
    return joined.groupBy("customerId", "eventId").agg(F.sum(attempts).alias("fired"))


def build_alerts(
    events: DataFrame,
    rules: DataFrame | PreparedRules,
    tag: str = DEFAULT_TAG,
    renderers: dict | None = None,
) -> DataFrame:
    """The outbox: one ready-to-send row per (rule, event, channel entry).

    Rows are independent of each other, so a delivery that fails for one leaves
    the rest untouched; nothing is put back in the queue.
    """
    renderers = renderers or CHANNEL_PAYLOADS
    rows = deliverable(explode_channels(match_rules(events, rules)), tuple(renderers))
    identity = F.concat_ws(
        "|", F.col("ruleId"), F.col("ruleCustomerId"), F.col("eventId"), F.col("channelPos").cast("string")
    )
    texts = rows.withColumns({"subject": alert_subject(tag), "body": alert_body()})
    return texts.select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("alert_id"),
        F.col("ruleId").alias("rule_id"),
        F.col("eventId").alias("event_id"),
        F.col("ruleCustomerId").alias("customer_id"),
        F.col("timestamp").alias("triggered_at"),
        "channel",
        F.col("channelPos").alias("channel_pos"),
        "subject",
        "body",
        channel_payload(F.col("channel"), F.col("subject"), F.col("body"), renderers).alias("payload"),
        F.lit("pending").alias("status"),
    )


def rules_by_customer(rules: DataFrame) -> DataFrame:
    """Each tenant's rules, enabled or not, grouped under the tenant.

    Grouping counts first, so the shuffle carries one row per tenant and task.
    """
    return rules.groupBy("customerId").agg(
        F.count("*").alias("rule_count"),
        F.count_if(F.coalesce(F.col("enabled"), F.lit(True))).alias("enabled_count"),
        F.min("ruleId").alias("first_rule"),
        F.max("ruleId").alias("last_rule"),
    )
