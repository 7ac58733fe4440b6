"""The enrichment steps and their ordered chain."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailwarden.functions.eventjson import empty_controls, empty_tags
from trailwarden.schemas import CONTROL, CONTROL_MAP, EVENT_TYPES, USER_CONTEXT_TAG


@dataclass(frozen=True)
class Step:
    """One enrichment step; steps run by ascending ``order``."""

    apply: Callable[[DataFrame], DataFrame]
    order: int = 0
    name: str = ""


def fill_defaults(events: DataFrame) -> DataFrame:
    """Absent flag, controls and tags; the risk level is filled when decoding."""
    return events.withColumns(
        {
            "anomalous": F.coalesce(F.col("anomalous"), F.lit(False)),
            "controls": F.coalesce(F.col("controls"), empty_controls()),
            "tags": F.coalesce(F.col("tags"), empty_tags()),
        }
    )


def put_if_absent(tags: Column, key: str, value: Column) -> Column:
    """Map with ``key`` set unless it already has a non-null value.

    Written over the entries without a lambda, so the projection stays in
    whole-stage code generation.
    """
    tags = F.coalesce(tags, empty_tags())

    def entry(v: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), v.cast("string").alias("value"))

    others = F.array_remove(F.map_entries(tags), entry(F.lit(None)))
    return F.when(F.element_at(tags, key).isNotNull(), tags).otherwise(
        F.map_from_entries(F.array_append(others, entry(value)))
    )


def add_user_context(events: DataFrame) -> DataFrame:
    context = F.when(F.col("userId").isNotNull(), F.lit("resolved")).otherwise(F.lit("unknown"))
    return events.withColumn("tags", put_if_absent(F.col("tags"), USER_CONTEXT_TAG, context))


def default_controls(spark: SparkSession) -> DataFrame:
    """The built-in control rows: eventType, position, controlId, framework, name."""
    rows = [
        {"eventType": t, "position": i, "controlId": c, "framework": f, "name": n}
        for i, (t, c, f, n) in enumerate(CONTROL_MAP)
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def controls_by_type(controls: DataFrame) -> DataFrame:
    """One row per event type with its controls in listing order.

    Only the known event types are kept, so the result has at most six rows.
    """
    none = F.array().cast("array<string>")
    entry = F.struct(
        F.col("controlId"),
        F.col("framework"),
        F.col("name"),
        F.lit(None).cast("string").alias("description"),
        none.alias("evidenceTypes"),
        none.alias("queryPatterns"),
    )
    listed = F.sort_array(F.collect_list(F.struct(F.col("position"), entry.alias("control"))))
    return (
        controls.where(F.col("eventType").isin(*EVENT_TYPES))
        .groupBy("eventType")
        .agg(F.transform(listed, lambda r: r["control"]).alias("_controls"))
        .withColumnRenamed("eventType", "_control_type")
    )


def _builtin_controls() -> Column:
    """The built-in map of event type to controls, folded into one constant."""
    by_type: dict[str, list[dict]] = {}
    for event_type, control_id, framework, name in CONTROL_MAP:
        entry = {"controlId": control_id, "framework": framework, "name": name}
        by_type.setdefault(event_type, []).append(entry | {"evidenceTypes": [], "queryPatterns": []})
    kind = T.MapType(T.StringType(), T.ArrayType(CONTROL))
    return F.from_json(F.lit(json.dumps(by_type)), kind)


def classify_controls(events: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Replace ``controls`` by those the event's type is evidence for.

    The built-in controls are a constant lookup; a table of controls is reduced
    to one row per type and broadcast.
    """
    if controls is None:
        found = F.try_element_at(_builtin_controls(), F.col("type"))
        return events.withColumn("controls", F.coalesce(found, empty_controls()))
    lookup = F.broadcast(controls_by_type(controls))  # at most six rows
    joined = events.join(lookup, F.col("type") == F.col("_control_type"), "left")
    return joined.withColumn("controls", F.coalesce(F.col("_controls"), empty_controls())).drop(
        "_control_type", "_controls"
    )


def detect_anomalies(events: DataFrame) -> DataFrame:
    """Flag exports and critical permission changes; a flagged event is HIGH.

    The flag is always overwritten, and HIGH replaces even CRITICAL.
    """
    suspicious = (F.col("type") == "DATA_EXPORT") | (
        (F.col("type") == "PERMISSION_CHANGE") & (F.col("riskLevel") == "CRITICAL")
    )
    return events.withColumn("anomalous", F.coalesce(suspicious, F.lit(False))).withColumn(
        "riskLevel", F.when(F.col("anomalous"), F.lit("HIGH")).otherwise(F.col("riskLevel"))
    )


def default_steps(controls: DataFrame | None = None) -> list[Step]:
    return [
        Step(detect_anomalies, 30, "anomaly"),
        Step(add_user_context, 10, "user-context"),
        Step(lambda df: classify_controls(df, controls), 20, "controls"),
    ]


def enrich(events: DataFrame, steps: Iterable[Step] | None = None) -> DataFrame:
    """Run the steps by their order (ties keep the given sequence)."""
    chain = sorted(default_steps() if steps is None else steps, key=lambda s: s.order)
    for step in chain:
        events = events.transform(step.apply)
    return events
