"""Mixing sources to target weights by repetition rates.

Words are summed per source, targets are found by resharing what capped
sources cannot take, and every document is emitted floor(rate) times plus one
more with a probability equal to the fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import WORD, saved, table, unused
from trailwarden.operators.ranking import with_row_index

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone (a null id counts as the word null)."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources take the weights 1, 2, 3, 1, ... in code point order, null last.
    A source over its cap is fixed there and the rest is shared again by
    weight among the others. One round sums two numbers; there are at most as
    many rounds as sources, and in practice a handful.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = with_row_index(saved(per_source, "mix-sources"), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("row_index") % len(WEIGHTS) + 1).cast("int"))
    shares = saved(
        ordered.select("source", "source_size", weight.cast("long").alias("weight"),
                       (MAX_REPEATS * F.col("source_size")).alias("cap")),
        "mix-shares",
    )
    level = None  # words per unit of weight
    while True:
        capped = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        total, fixed, weights = shares.agg(
            F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
        ).first()
        if not weights:
            break
        again = (total - fixed) / weights
        if again == level:
            break
        level = again
    share = F.col("weight") * F.lit(float(level or 0))
    return shares.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _copies(total: Column, target: Column, doc_id: Column) -> Column:
    rate = F.when(total > 0, target / total).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(coin(doc_id) < rate - whole, 1).otherwise(0)).cast("long")


def with_copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size with source_size, target and copies of each document.

    Null texts have size 0 and stay with their source's rate; a source without
    words has rate 0. Rows that repeat a doc_id take the same decision. An
    empty table gives an empty table.
    """
    sizes = saved(docs.select("doc_id", "source", n_words(docs["text"]).alias("size")), "mix-sizes")
    targets = saved(source_targets(sizes), "mix-targets").withColumnRenamed("source", "_source")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("copies", _copies(F.col("source_size"), F.col("target"), F.col("doc_id")))


def mix(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it; the columns stay as they are."""
    source, total, target, copies = unused(docs, "_source", "_total", "_target", "_copies")
    targets = saved(
        source_targets(docs.select("source", n_words(docs["text"]).alias("size"))), "mix-targets"
    ).select(F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target))
    joined = docs.join(targets, docs["source"].eqNullSafe(F.col(source)))
    counted = joined.withColumn(copies, _copies(F.col(total), F.col(target), docs["doc_id"])).where(F.col(copies) > 0)
    return counted.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: {docs} is the table mixed; gives every row with its copies.
ORACLE = r"""
WITH sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources
), steps AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place,
         sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER before, 0) AS fixed,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
  FROM weighed
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((total - fixed)::DOUBLE / rest, place) FILTER (WHERE cap >= weight * ((total - fixed)::DOUBLE / rest)) AS level FROM steps
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM steps, level
), rated AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT *, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
"""
SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM ({ORACLE.format(docs='documents')})"
