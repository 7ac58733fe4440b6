"""Alert rules from a JSON array."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.functions.text import is_missing
from trailwarden.schemas import ALERT_RULE, EVENT_TYPES, RISK_LEVELS

#: Faults a refused file is reported with.
LISTED_FAULTS = 20


def no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ALERT_RULE)


def load_rules(spark: SparkSession, location: str | None) -> DataFrame:
    """Rules of a file (or folder of files), defaults filled in.

    No location or a missing file means no rules. A file that is unreadable, is
    no array, or names a tenant, type, level or flag that does not exist is
    refused as a whole: a rule that silently means something else is worse than
    none.
    """
    if not location or not location.strip():
        return no_rules(spark)
    reader = spark.read.schema(ALERT_RULE).option("multiLine", True).option("mode", "FAILFAST")
    try:
        rules = reader.json(location)
        documents = spark.read.option("wholetext", True).text(location)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return no_rules(spark)
        raise
    if documents.where(~F.btrim("value", F.lit(" \t\r\n\ufeff")).startswith("[")).take(1):
        raise ValueError(f"{location}: rules must be an array")
    faults = rule_faults(rules).limit(LISTED_FAULTS).collect()
    if faults:
        raise ValueError(f"{location}: " + "; ".join(f"rule {r.ruleId}: {r.fault}" for r in faults))
    return fill_rule_defaults(rules)


def rule_faults(rules: DataFrame) -> DataFrame:
    """(ruleId, fault) of rules with a value outside its domain or without id or tenant."""
    fault = (
        F.when(is_missing(F.col("ruleId")), F.lit("no ruleId"))
        .when(is_missing(F.col("customerId")), F.lit("no customerId"))
        .when(~F.col("eventType").isin(*EVENT_TYPES), F.concat(F.lit("unknown eventType "), F.col("eventType")))
        .when(~F.col("riskThreshold").isin(*RISK_LEVELS), F.concat(F.lit("unknown riskThreshold "), F.col("riskThreshold")))
    )
    return rules.select("ruleId", fault.alias("fault")).where("fault IS NOT NULL")


def fill_rule_defaults(rules: DataFrame) -> DataFrame:
    return rules.withColumns(
        {
            "enabled": F.coalesce("enabled", F.lit(True)),
            "notificationChannels": F.coalesce("notificationChannels", F.array().cast("array<string>")),
        }
    )
