"""Durable high-water marks of pulled sources.

A mark is a version of its source: one small folder, written after the rows up
to it are delivered. A poller states the mark it started from; if another one
has moved it meanwhile, advancing fails instead of going back or skipping.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.sinks.folders import drop_folders, folders
from trailwarden.sources.collectors import Collector
from trailwarden.sources.querylog import DEFAULT_BATCH, drained_batch, log_events, source_name

#: Versions kept behind the latest one.
HISTORY = 10


class StaleMark(RuntimeError):
    """Another poller has moved the mark."""


@dataclass(frozen=True)
class Mark:
    version: int
    at: datetime | None


@dataclass(frozen=True)
class Marks:
    root: str

    def _folder(self, source: str) -> str:
        return f"{self.root.rstrip('/')}/{quote(source, safe='')}"

    def _versions(self, spark: SparkSession, source: str) -> list[int]:
        """Versions whose write was committed."""
        names = folders(spark, self._folder(source), "version=", below="_SUCCESS")
        return sorted(int(n.split("/")[0].removeprefix("version=")) for n in names)

    def current(self, spark: SparkSession, source: str) -> Mark:
        """The latest mark; version 0 without a time before the first one."""
        versions = self._versions(spark, source)
        if not versions:
            return Mark(0, None)
        row = spark.read.schema("at timestamp").parquet(f"{self._folder(source)}/version={versions[-1]}").first()
        return Mark(versions[-1], row["at"])

    def advance(self, spark: SparkSession, source: str, seen: Mark, at: datetime) -> Mark:
        """Move on from ``seen``; raises ``StaleMark`` if that is no longer the latest, or ``at`` lies before it."""
        if self.current(spark, source) != seen or (seen.at and at < seen.at):
            raise StaleMark(f"{source}: the mark is no longer at version {seen.version}")
        folder, version = self._folder(source), seen.version + 1
        moved = spark.range(1).select(F.lit(at).cast("timestamp").alias("at"))
        # an unfinished version is left over from a failure; a finished one has just been looked for
        moved.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")
        drop_folders(spark, folder, [f"version={v}" for v in self._versions(spark, source)[:-HISTORY]])
        return Mark(version, at)


def log_collector(log: DataFrame, marks: Marks, customer_id: str, resource: str, since: str | datetime, batch: int = DEFAULT_BATCH) -> Collector:
    """A query log as a collector: reads from the stored mark, moves it once its events are delivered.

    Rows that tie with the mark were read with it. An empty or all-noise batch
    delivers no events; only rows read move the mark.
    """
    spark, source, state = log.sparkSession, source_name(resource), {}

    def collect() -> DataFrame:
        seen = marks.current(spark, source)
        rows = drained_batch(log, since if seen.at is None else seen.at, batch)
        state.update(seen=seen, at=rows.agg(F.max("event_time")).first()[0])
        return log_events(rows, customer_id, resource)

    def commit() -> None:
        if state["at"] is not None:
            marks.advance(spark, source, state["seen"], state["at"])

    return Collector(source, collect, commit)
