"""A global row number without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailwarden.session import new_workdir

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row index below


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the total order.

    Rows are range-partitioned and sorted, each partition numbers its own, and
    the partitions' starting points come from their sizes - one row per
    partition.  The sorted rows are written to the shared folder once, because
    partition bounds are sampled and must not differ between the two readings.
    """
    spark = df.sparkSession
    path = new_workdir(spark, "row-index")
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    placed = spark.read.parquet(path)
    part = F.shiftright("_id", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_part", "_start", "_id")
    )
