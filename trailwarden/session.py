"""Session set-up and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

UTC_CONF = ("spark.sql.session.timeZone", "UTC")


def build_session(app: str = "trailwarden", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect.

    Shuffle partition counts are left to adaptive execution on a cluster; pass
    ``spark.sql.shuffle.partitions`` for small local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        UTC_CONF[0]: UTC_CONF[1],
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Instants are rendered and truncated in UTC everywhere."""
    if spark.conf.get(UTC_CONF[0]) != UTC_CONF[1]:
        spark.conf.set(*UTC_CONF)


@functools.cache
def _own_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="trailwarden-")


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only on a single machine (tests) may the setting be absent: one temporary
    folder then serves the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return _own_root(spark.sparkContext.applicationId)


def new_workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root for one job's tables."""
    return f"{shared_root(spark).rstrip('/')}/trailwarden/{name}-{uuid.uuid4().hex}"
