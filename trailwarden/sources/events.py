"""Event records from a topic or from files, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailwarden.functions.eventjson import decode_events
from trailwarden.schemas import REQUEST

# --- Fixed values -----------------------------------------------------------
RAW_TOPIC = "audit-events"
ENRICHED_TOPIC = "audit-events-enriched"
ENRICHMENT_GROUP = "enrichment-service"
ALERTING_GROUP = "alerting-service"
# ----------------------------------------------------------------------------

RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def kafka_options(servers: str, topic: str, group: str, **extra: str) -> dict[str, str]:
    """Reader options: a group's first run starts at the earliest record.

    ``extra`` passes through settings such as ``maxOffsetsPerTrigger``,
    ``minPartitions`` or ``kafka.security.protocol``.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "groupIdPrefix": group,
        "failOnDataLoss": "true",
        **extra,
    }


def kafka_records(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """(key, value, seq) of a topic.  Needs the Spark Kafka package.

    ``seq`` orders records as the broker did within a partition; a key stays in
    one partition, so it orders the records of a tenant. Partition numbers have
    13 bits; a topic with more partitions is refused.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options)
    partition = F.col("partition").cast("bigint")
    refused = F.raise_error(F.lit("more than 8192 partitions")).cast("bigint")
    seq = F.when(partition < 1 << 13, F.shiftleft(F.col("offset"), 13).bitwiseOR(partition)).otherwise(refused)
    return reader.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        seq.alias("seq"),
    )


def file_records(
    spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    """(key, value, seq) records kept as Parquet files in place of a topic."""
    if not streaming:
        return spark.read.schema(RECORD).parquet(path)
    reader = spark.readStream.schema(RECORD)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def decoded(records: DataFrame) -> DataFrame:
    """Events that decode; the others are in ``quarantined``."""
    good = decode_events(records).where(F.col("decode_error").isNull())
    return good.drop("decode_error", "key", "value")


def quarantined(records: DataFrame) -> DataFrame:
    """Records that do not decode, as received, with the reason."""
    bad = decode_events(records).where(F.col("decode_error").isNotNull())
    keep = [c for c in records.columns]
    return bad.select(*keep, "decode_error")


def request_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Pushed requests from a landing folder of JSON lines.

    A line that is no JSON object keeps its text in ``malformed`` and goes the
    way of all rejects.
    """
    schema = T.StructType([*REQUEST.fields, T.StructField("malformed", T.StringType())])
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("columnNameOfCorruptRecord", "malformed").json(path)
