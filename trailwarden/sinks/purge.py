"""Retention on the stored metadata table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.operators.retention import (
    DEFAULT_BATCH,
    DEFAULT_DAYS,
    cutoff_for,
    kept,
    purge_summary,
)
from trailwarden.sinks.folders import drop_folders
from trailwarden.sinks.idindex import MERGED
from trailwarden.sinks.tables import Stores, day_folders, read_table


def purge_metadata(
    spark: SparkSession,
    stores: Stores,
    now: datetime,
    days: int = DEFAULT_DAYS,
    batch: int = DEFAULT_BATCH,
) -> tuple[int, int]:
    """Remove expired rows; returns (rows deleted, statements).

    Folders wholly before the cutoff are dropped.  Only the folder the cutoff
    falls in is read and rewritten.  Running it again after a failure is safe.
    Removed ids leave the id index last, so they may be stored anew.
    """
    day = stores.first_day(cutoff_for(now, days).date())
    table = read_table(spark, stores, "metadata", last=day)
    counts = purge_summary(table, now, days, batch).first()
    boundary = table.where(F.col("event_date") == F.lit(day))
    left = kept(boundary, now, days)
    batches = ("writer", "batch_id")
    emptied = boundary.select(*batches).distinct().join(left.select(*batches).distinct(), list(batches), "left_anti")
    # Folder names only: one per stored day, and at most one per batch of one day.
    names = [n for n in day_folders(spark, stores, "metadata", last=day) if n != f"event_date={day}"]
    names += [f"event_date={day}/writer={r.writer}/batch_id={r.batch_id}" for r in emptied.collect()]
    names.append(f"event_date={day}/writer={MERGED}")  # what is left of merged batches gets folders of their own again
    (
        left.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", *batches)
        .parquet(stores.path("metadata"))
    )
    drop_folders(spark, stores.path("metadata"), names)
    stores.ids().forget_before(spark, cutoff_for(now, days))
    return counts["deleted"], counts["statements"]


def surviving(spark: SparkSession, stores: Stores) -> DataFrame:
    return read_table(spark, stores, "metadata").drop("event_date", "writer", "batch_id")
