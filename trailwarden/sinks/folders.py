"""Short listings and deletions of table folders."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _root(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, root: str, prefix: str, below: str | None = None) -> list[str]:
    """Names of the folders of ``root`` that start with ``prefix``, or their ``below`` (a pattern), as paths under it."""
    path, fs = _root(spark, root)
    if not fs.exists(path):
        return []
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{prefix}*/{below}" if below else f"{prefix}*")
    base = str(fs.makeQualified(path).toUri().getPath())
    found = fs.globStatus(pattern)
    return sorted(str(s.getPath().toUri().getPath())[len(base):].strip("/") for s in found) if found else []


def drop_folders(spark: SparkSession, root: str, names: list[str]) -> None:
    path, fs = _root(spark, root)
    for name in names:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name), True)
