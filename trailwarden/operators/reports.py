"""Compliance reports.

One parameterised report serves every framework.  A report is a table of lines
with an order, so a long one is sorted and written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwarden.functions.text import iso_instant
from trailwarden.operators.evidence import instant
from trailwarden.schemas import REPORT_TITLES


def _has_control(framework: str) -> Column:
    return F.coalesce(F.array_contains(F.col("controls.framework"), framework), F.lit(False))


def relevant_events(events: DataFrame, framework: str) -> DataFrame:
    """Events that are evidence for at least one control of the framework."""
    return events.where(_has_control(framework))


def _column(framework: str | Column) -> Column:
    return F.lit(framework) if isinstance(framework, str) else framework


def control_ids(framework: str | Column) -> Column:
    """The framework's control ids of an event, distinct, in first-seen order."""
    mine = F.filter("controls", lambda c: c["framework"] == _column(framework))
    return F.array_join(F.array_distinct(F.transform(mine, lambda c: c["controlId"])), ",")


def report_line(framework: str | Column) -> Column:
    return F.concat(
        F.col("eventId"),
        F.lit(" | "), F.coalesce(F.col("type"), F.lit("null")),
        F.lit(" | controls="), control_ids(framework),
        F.lit(" | risk="), F.coalesce(F.col("riskLevel"), F.lit("null")),
    )


def framework_lines(events: DataFrame, frameworks=tuple(REPORT_TITLES)) -> DataFrame:
    """Event lines of all reports in one pass: an event is a line of each framework it has controls of."""
    wanted = F.array_intersect(F.col("controls.framework"), F.lit(list(frameworks)))
    return events.withColumn("framework", F.explode(wanted)).select(
        "framework", "customerId", "eventId", F.col("timestamp").alias("event_time"),
        report_line(F.col("framework")).alias("line"),
    )


def report_lines(events: DataFrame, framework: str) -> DataFrame:
    """Event lines of a report.  Scope comes from the evidence query alone."""
    return relevant_events(events, framework).select(
        F.lit(framework).alias("framework"),
        "customerId",
        "eventId",
        F.col("timestamp").alias("event_time"),
        report_line(framework).alias("line"),
    )


def report_summary(events: DataFrame, frameworks=tuple(REPORT_TITLES)) -> DataFrame:
    """Relevant events per framework in one pass, 0 included."""
    counts = events.agg(
        *[
            F.count_if(_has_control(framework)).alias(framework) for framework in frameworks
        ]
    )
    rows = F.array(*[F.struct(F.lit(f).alias("framework"), F.col(f).alias("events")) for f in frameworks])
    return counts.select(F.inline(rows))


def report_documents(events: DataFrame, customer_id: str, start, end, frameworks=tuple(REPORT_TITLES)) -> DataFrame:
    """Whole reports as rows (framework, part, event_time, eventId, line), unordered.

    Parts 0-3 are the header, part 4 the event lines; ``ordered_report`` puts
    them in reading order. Lines and their counts come out of one aggregation
    over two grouping sets, so the events are read once.
    """
    keys = ("framework", "event_time", "eventId", "line")
    lines = framework_lines(events, frameworks).select(*keys, F.lit(1).alias("rows"))
    # a row of no weight per framework: a report without events has a header, too
    nothing = {k: F.lit(None).cast(lines.schema[k].dataType) for k in keys[1:]}
    named = events.sparkSession.range(1).select(F.explode(F.lit(list(frameworks))).alias("framework"))
    both = lines.unionByName(named.withColumns({**nothing, "rows": F.lit(0)}))
    counted = both.groupingSets([["framework"], list(keys)], *keys).agg(
        F.sum("rows").cast("int").alias("n"), F.grouping("line").alias("head")
    )
    titles = F.create_map(*[F.lit(x) for f in frameworks for x in (f, REPORT_TITLES.get(f, f"{f} Report"))])
    period = F.concat(F.lit("Period: "), iso_instant(instant(start)), F.lit(" - "), iso_instant(instant(end)))
    heads = (titles[F.col("framework")], F.lit(f"Customer: {customer_id}"), period, F.concat(F.lit("Events: "), F.col("n").cast("string")))
    part = lambda k, text: F.struct(F.lit(k).alias("part"), text.alias("line"))
    rows = F.when(F.col("head") == 1, F.array(*[part(k, t) for k, t in enumerate(heads)])).otherwise(
        F.array_repeat(part(len(heads), F.col("line")), F.col("n"))
    )
    return counted.select("framework", "event_time", "eventId", F.inline(rows)).select("framework", "part", "event_time", "eventId", "line")


def report_document(events: DataFrame, framework: str, customer_id: str, start, end) -> DataFrame:
    """One framework's report; see ``report_documents``."""
    return report_documents(events, customer_id, start, end, (framework,)).drop("framework")


def ordered_report(document: DataFrame) -> DataFrame:
    """One text column in reading order (a range-partitioned sort)."""
    return document.orderBy("part", "event_time", "eventId").select(F.col("line").alias("value"))
