"""Database query log: collect, filter, normalize, checkpoint."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.functions.eventjson import empty_controls, empty_tags
from trailwarden.functions.logtext import (
    LOG_COMMANDS,
    is_noise,
    log_event_id,
    log_user,
    noise_reason,
    statement_keyword,
    statement_text,
)
from trailwarden.functions.text import redact_sql
from trailwarden.schemas import EVENT_COLUMNS, GENERAL_LOG

DEFAULT_BATCH = 500


def jdbc_options(
    url: str, user: str, password: str, table: str = "mysql.general_log",
    lower: str | None = None, upper: str | None = None, partitions: int = 8,
) -> dict[str, str]:
    """Reader options; with bounds the read is split on ``event_time``."""
    options = {"url": url, "user": user, "password": password, "dbtable": table, "fetchsize": "10000"}
    if lower and upper:
        options |= {
            "partitionColumn": "event_time", "lowerBound": lower, "upperBound": upper,
            "numPartitions": str(partitions),
        }
    return options


def jdbc_log(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The log over JDBC (needs a driver on the class path).

    The filters of ``since_filter`` reach the database; the statement arrives as
    bytes and is decoded here.
    """
    log = spark.read.format("jdbc").options(**options).load()
    return log.select(
        F.col("event_time").cast("timestamp"),
        F.col("user_host").cast("string"),
        F.col("thread_id").cast("bigint"),
        F.col("command_type").cast("string"),
        F.decode(F.col("argument").cast("binary"), "UTF-8").alias("argument"),
    )


def file_log(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """A Parquet dump of the log."""
    if not streaming:
        return spark.read.schema(GENERAL_LOG).parquet(path)
    reader = spark.readStream.schema(GENERAL_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _mark(since: datetime | str | Column) -> Column:
    if isinstance(since, Column):
        return since
    return F.to_timestamp(F.lit(since.isoformat() if isinstance(since, datetime) else since))


def since_filter(log: DataFrame, since) -> DataFrame:
    """Statement rows newer than the high-water mark."""
    return log.where((F.col("event_time") > _mark(since)) & F.col("command_type").isin(*LOG_COMMANDS))


def collect_batch(log: DataFrame, since, batch: int = DEFAULT_BATCH) -> DataFrame:
    """The next ``batch`` rows in time order (thread and text break ties)."""
    order = [c for c in ("event_time", "thread_id", "argument", "seq") if c in log.columns]
    return since_filter(log, since).orderBy(*order).limit(batch)


def drained_batch(log: DataFrame, since, batch: int = DEFAULT_BATCH) -> DataFrame:
    """``collect_batch`` plus every row that ties with its last time.

    Advancing the mark to the last time read then skips nothing.
    """
    times = since_filter(log, since).select("event_time").orderBy("event_time").limit(batch)
    last = times.agg(F.max("event_time")).scalar()
    return since_filter(log, since).where(F.col("event_time") <= last)


def checkpoints(log: DataFrame, since, batch: int = DEFAULT_BATCH) -> DataFrame:
    """Marks after a poll: ours, and the whole-log maximum for comparison.

    ``mark`` is the last time of the drained batch, ``log_maximum`` the largest
    time in the log of any command; neither falls below ``since``.
    """
    start = _mark(since)
    drained = drained_batch(log, since, batch).agg(
        F.count("*").alias("rows_read"), F.greatest(F.max("event_time"), start).alias("mark")
    )
    highest = log.agg(F.greatest(F.max("event_time"), start)).scalar()
    return drained.withColumn("log_maximum", highest)


def with_noise(log: DataFrame) -> DataFrame:
    """Add the trimmed ``statement`` and the ``noise`` reason (null = keep)."""
    return log.withColumn("statement", statement_text(F.col("argument"))).withColumn(
        "noise", noise_reason(F.col("statement"))
    )


def log_events(log: DataFrame, customer_id: str, resource: str) -> DataFrame:
    """Log rows as redacted events; noise is left out, raw text never kept."""
    wanted = log.where(F.col("command_type").isin(*LOG_COMMANDS)).where(~is_noise(F.col("argument")))
    rows = wanted.withColumn("statement", statement_text(F.col("argument")))
    none = F.lit(None).cast("string")
    columns = {
        "eventId": log_event_id(F.col("event_time"), F.col("thread_id"), F.col("statement")),
        "customerId": F.lit(customer_id),
        "userId": log_user(F.col("user_host")),
        "timestamp": F.col("event_time"),
        "type": F.lit("DATABASE_QUERY"),
        "resource": F.lit(resource),
        "action": statement_keyword(F.col("statement")),
        "query": redact_sql(F.col("statement")),
        "controls": empty_controls(),
        "riskLevel": F.lit("LOW"),
        "anomalous": F.lit(False),
        "tags": empty_tags(),
    }
    extra = ["seq"] if "seq" in log.columns else []
    return rows.select(*extra, *[columns.get(c, none).alias(c) for c in EVENT_COLUMNS])


def source_name(resource: str) -> str:
    return f"mysql-general-log:{resource}"


def wire_requests(events: DataFrame) -> DataFrame:
    """The seven fields an agent forwards; the event time is not among them."""
    extra = ["seq"] if "seq" in events.columns else []
    return events.select(*extra, "eventId", "customerId", "userId", "type", "resource", "action", "query")
