"""Merging the small folders that micro-batches leave.

A stream adds a folder to every day it touches with each batch. ``compact_table``
merges a day's (or tenant bucket's) folders into one that is sorted like them
and keeps each row's writer and batch as columns.

The merged folder is there before the others go, and as long as a batch has a
folder of its own, readers take that one: a merge that ends half way shows
neither lost nor repeated rows, and the next one cleans up. A batch replayed
after it was merged gets a folder of its own again and so replaces its rows. The
newest batch of each writer stays out, since it is the one a running stream may
be writing again. Readers that planned before the old folders went must plan
anew, as after a purge.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trailwarden.sinks.folders import drop_folders
from trailwarden.sinks.idindex import MERGED
from trailwarden.sinks.tables import (
    SORTED,
    BatchFolder,
    Stores,
    batch_folders,
    day_folders,
    merged_rows,
    read_folders,
    table_schema,
)

#: So many folders of a day are merged.
LEAST = 8


def compact_table(
    spark: SparkSession, stores: Stores, table: str, first: date | None = None, last: date | None = None, least: int = LEAST
) -> int:
    """Merge the days, or tenant buckets, with ``least`` finished batches or more; gives their number.

    ``first`` and ``last`` bound the days of a dated table. Folder names come
    to the driver, as they do for every read of the table; rows do not.
    """
    if table not in SORTED:
        raise ValueError(f"not a table whose folders are merged: {table}")
    days = set(day_folders(spark, stores, table, first, last)) if first or last else None
    heads: dict[str, list[BatchFolder]] = defaultdict(list)
    for f in batch_folders(spark, stores, table):
        if days is None or f.head in days:
            heads[f.head].append(f)
    finished, merges, single = [], [], []
    for found in heads.values():
        own = [f for f in found if f.writer != MERGED]
        newest = {w: max(f.batch for f in own if f.writer == w) for w in {f.writer for f in own}}
        done = [f for f in own if f.batch < newest[f.writer]]
        if len(done) >= least:
            finished += done
            single += own
            merges += [f for f in found if f.writer == MERGED]
    if not finished:
        return 0
    rows = read_folders(spark, stores, table, [f.name for f in finished])
    if merges:
        rows = rows.unionByName(merged_rows(spark, stores, table, merges, single))
    number = 1 + max((f.batch for f in merges), default=-1)
    key = SORTED[table][0]
    (
        rows.withColumns({"of_writer": F.col("writer"), "of_batch": F.col("batch_id")})
        .withColumns({"writer": F.lit(MERGED), "batch_id": F.lit(number).cast("bigint")})
        .select(*table_schema(table, merged=True).fieldNames())
        .hint("rebalance", key).sortWithinPartitions(*SORTED[table])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key, "writer", "batch_id").parquet(stores.path(table))
    )
    drop_folders(spark, stores.path(table), [f.name for f in [*finished, *merges]])
    return len({f.head for f in finished})
