"""An index of stored ids, for inserting what is absent without reading the table.

Ids are dealt to hash buckets; a bucket is a folder, a batch adds one small
sorted file to each bucket it touches, with min/max and a Bloom filter per row
group. A lookup reads the buckets of its own ids and no others. Buckets with
many files are merged, oldest first to last, into one.

Layout  bucket / writer / batch_id / (event_id, occurred_at, by_writer, by_batch)

A batch that is replayed does not meet itself: rows that it wrote, merged or
not, are told by ``by_writer`` and ``by_batch`` and left out of its lookup.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.sinks.folders import drop_folders, folders

MERGED = "_merged"
#: A bucket with this many files is merged into one.
FANOUT = 8
#: So few ids are looked up by value, which row groups answer from their Bloom filters.
PUSHED_IDS = 10
#: A batch with more rows is not asked whether it has so few ids.
PUSHED_ROWS = 1000
SCHEMA = "event_id string, occurred_at timestamp, by_writer string, by_batch bigint, bucket int, writer string, batch_id string"


@dataclass(frozen=True)
class IdIndex:
    root: str
    buckets: int = 32

    def bucket(self, event_id: str = "event_id") -> Column:
        return F.pmod(F.xxhash64(event_id), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, names: list[str]) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in names]
        if not paths:
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).option("basePath", self.root).parquet(*paths)

    def _write(self, rows: DataFrame) -> None:
        (
            rows.repartition("bucket").sortWithinPartitions("bucket", "writer", "batch_id", "event_id")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("parquet.bloom.filter.enabled#event_id", "true")
            .partitionBy("bucket", "writer", "batch_id").parquet(self.root)
        )

    def stored(self, spark: SparkSession, ids: DataFrame, writer: str, batch: int) -> DataFrame:
        """(bucket, event_id) that others stored, from the buckets of ``ids`` only, which may repeat.

        At most ``buckets`` numbers and ``PUSHED_ROWS`` ids come to the driver; no id is shuffled.
        """
        wanted = {f"bucket={r[0]}" for r in ids.select(self.bucket()).distinct().collect()}
        rows = self._read(spark, sorted(wanted & set(folders(spark, self.root, "bucket="))))
        some = [r[0] for r in ids.select("event_id").limit(PUSHED_ROWS + 1).collect()]
        few = set(some)
        if len(some) <= PUSHED_ROWS and len(few) <= PUSHED_IDS:
            rows = rows.where(F.col("event_id").isin(sorted(few)))
        mine = F.col("by_writer").eqNullSafe(F.lit(writer)) & F.col("by_batch").eqNullSafe(F.lit(batch))
        return rows.where(~mine).select("bucket", "event_id")

    def claim(self, rows: DataFrame, writer: str, batch: int) -> DataFrame:
        """Put the ids of a batch that nobody stored before into the index; gives these ids.

        ``rows`` have event_id and occurred_at. Where an id repeats, the latest
        of its times counts for retention.
        """
        spark = rows.sparkSession
        drop_folders(spark, self.root, self._own(spark, writer, batch))  # of an attempt that failed
        ids = rows.groupBy("event_id").agg(F.max("occurred_at").alias("occurred_at")).withColumn("bucket", self.bucket())
        fresh = ids
        if folders(spark, self.root, "bucket=", below="*/*"):  # of others; the first batch of a store has nobody to ask
            fresh = ids.join(self.stored(spark, rows, writer, batch), ["bucket", "event_id"], "left_anti")
        self._write(fresh.select(
            "event_id", "occurred_at", F.lit(writer).alias("by_writer"), F.lit(batch).cast("bigint").alias("by_batch"),
            "bucket", F.lit(writer).alias("writer"), F.lit(str(batch)).alias("batch_id")))
        return self._read(spark, self._own(spark, writer, batch)).select("event_id")

    def _own(self, spark: SparkSession, writer: str, batch: int) -> list[str]:
        return folders(spark, self.root, "bucket=", below=f"writer={writer}/batch_id={batch}")

    def compact(self, spark: SparkSession, fanout: int = FANOUT, keep: Column | None = None) -> int:
        """Merge the buckets that have ``fanout`` files or more; gives their number.

        The merged file is there before the others go. A crash in between
        leaves ids twice, which no lookup minds. With ``keep`` all buckets are
        rewritten and only rows that satisfy it stay.
        """
        parts: dict[str, list[str]] = {}
        for name in folders(spark, self.root, "bucket=", below="*/*"):
            parts.setdefault(name.split("/")[0], []).append(name)
        full = [n for names in parts.values() if len(names) >= fanout or keep is not None for n in names]
        if not full:
            return 0
        rows = self._read(spark, full)
        if keep is not None:
            rows = rows.where(keep)
        generation = uuid.uuid4().hex
        self._write(rows.withColumns({"writer": F.lit(MERGED), "batch_id": F.lit(generation)}))
        drop_folders(spark, self.root, full)
        return len({n.split("/")[0] for n in full})

    def forget_before(self, spark: SparkSession, cutoff: datetime) -> None:
        """Drop ids whose rows retention has removed, so that they may be stored anew."""
        limit = F.to_timestamp(F.lit(cutoff.isoformat()))
        self.compact(spark, keep=F.coalesce(F.col("occurred_at") >= limit, F.lit(True)))
