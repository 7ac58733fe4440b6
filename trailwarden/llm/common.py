"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.session import new_workdir

#: The white space that separates words, and a word, as the contracts fix them.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write a working table to the shared folder and read it back.

    This cuts lineage: a lost executor costs its own tasks, never the job
    before this table, and a plan that reads it twice computes it once.
    """
    spark = df.sparkSession
    path = new_workdir(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folded(text: Column) -> Column:
    """A text that two texts share exactly if they differ in the case of A-Z only.

    For comparing and hashing, not for reading: the UTF-8 bytes are taken for
    Latin-1 and put in lower case. That moves A-Z and the first bytes of longer
    characters (C0-DE to E0-FE); since those are told apart by the number of
    bytes that follow, no two texts fall together that should not.
    """
    return F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def lacks(df: DataFrame) -> bool:
    """No row at all; reads one row at most."""
    return not df.take(1)
