"""Duplicate handling: three different rules for three different stores.

All of them are plain aggregations with a map-side partial step, so a key that
accounts for a large share of the rows is reduced to one row per task before
anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _pick(df: DataFrame, keys: list[str], chooser, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = chooser(F.struct(*[F.col(c) for c in rest]), order)
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First write wins; ``order`` must be non-null and unique within a key."""
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last write wins; ``order`` must be non-null and unique within a key."""
    return _pick(df, keys, F.max_by, order)


def insert_if_absent(batch: DataFrame, target: DataFrame | None, key: str, order: Column) -> DataFrame:
    """Rows of ``batch`` that a unique key on ``target`` would let in.

    One anti join on the key column of ``target``; adaptive execution broadcasts
    the smaller side where its measured size allows. Stored tables answer from
    their id index instead (``sinks.idindex``).
    """
    fresh = first_per_key(batch, [key], order)
    return fresh if target is None else fresh.join(target.select(key), key, "left_anti")


def collapse_replays(df: DataFrame, key: str) -> DataFrame:
    """Rows that share a deterministic id are the same row; keep one."""
    return df.dropDuplicates([key])
