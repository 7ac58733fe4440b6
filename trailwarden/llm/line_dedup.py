"""Line de-duplication over levelled, sorted runs of line hashes.

Documents arrive in batches of ascending ids. The keys a corpus has shown so
far lie in *runs*: bucketed tables, each sorted by key. A batch brings its own
keys, one row each with the smallest document holding it; a merge anti join
against all runs leaves the new ones, which become a run of their own. As soon
as ``FANOUT`` runs lie on a level they are merged into one run on the next.

Everything is DataFrame functions. A line that a third of all documents share
is one row per task before any shuffle, and no later join has the line alone
as its key: what a document may keep is looked up by (document, line).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import BLANKS, folded, saved, table, unused
from trailwarden.session import new_workdir

MIN_LENGTH = 10
BATCHES = 4
FANOUT = 3
#: Keys of the corpus to a bucket of a run, some 4 MB: the buckets grow with the corpus, not with a setting.
BUCKET_KEYS = 250_000
#: Rows without an id count as one document behind all others.
LAST_ID = (1 << 63) - 1


def key_hashes(lines: Column) -> Column:
    """128 bits of each line's key; null for keys too short to be judged. Every step sees a line once."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    keys = F.transform(bare, lambda x: F.when(F.char_length(x) >= MIN_LENGTH, folded(x)))
    pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return F.transform(keys, lambda k: F.when(k.isNotNull(), pair(k)))


def _lines(docs: DataFrame) -> Column:
    return F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)


@dataclass
class LineRuns:
    """The runs of a corpus: tables bucketed and sorted by key, by level."""

    spark: SparkSession
    levels: list[list[str]] = field(default_factory=list)
    buckets: int = 0
    compactions: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", new_workdir(self.spark, name)).format("parquet").saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        return reduce(lambda left, run: left.join(run, ["h1", "h2"], "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> None:
        """Add new keys as a run, then merge the levels that are full."""
        self._write(keys.select("h1", "h2"), 0)
        level = 0
        while len(self.levels[level]) >= FANOUT:
            full, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.unionAll, [self.spark.table(n) for n in full]), level + 1)
            self.compactions += 1
            for name in full:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            level += 1

    def forget(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def _buckets(pairs: DataFrame) -> int:
    """Buckets of a run: one for ``BUCKET_KEYS`` pairs, two a core at least, unless the shuffle setting is less."""
    session = pairs.sparkSession
    least = min(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-pairs.count() // BUCKET_KEYS))


def _batch_edges(pairs: DataFrame, batches: int) -> list[int]:
    """Ids at which a batch ends; where they lie changes the work, never the result."""
    ids = pairs.where(F.col("doc") < LAST_ID)
    cuts = ids.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(c) for c in cuts})


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, drop): per document the key hashes it must lose; documents that lose none are absent."""
    spark = docs.sparkSession
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID))
    pairs = (
        docs.select(doc.alias("doc"), F.explode(key_hashes(_lines(docs))).alias("k"))
        .where("k IS NOT NULL").select("doc", "k.h1", "k.h2").distinct()
    )
    pairs = saved(pairs, "line-pairs")
    edges = _batch_edges(pairs, batches)
    runs, lost = LineRuns(spark, buckets=_buckets(pairs)), []
    bounds = list(zip([None, *edges], [*edges, None]))
    for low, high in bounds:
        batch = pairs
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        first = batch.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
        owners = saved(runs.unseen(first), "line-owners")
        runs.add(owners)
        lost.append(batch.join(owners, ["doc", "h1", "h2"], "left_anti"))
    out = saved(
        reduce(DataFrame.unionAll, lost).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("drop")),
        "line-drops",
    )
    runs.forget()
    return out


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds.

    Adds ``n_lines`` and ``n_dropped``; ``text`` holds the lines that stay and
    ``n_chars``, if there is one, its length. All other columns stay, but for
    columns named like the two counts, which give way to them.

    Null and empty texts are one empty line, which is never dropped. Rows that
    repeat a doc_id are one document: none of them loses a line to another.
    Rows without doc_id count together as the document behind all others. An
    empty table gives an empty table.
    """
    held = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    doc, drop, cut, stay = unused(docs, "_doc", "_drop", "_lines", "_kept")
    drops = dropped_lines(docs, batches).select(F.col("doc").alias(doc), F.col("drop").alias(drop))
    lines = F.arrays_zip(_lines(docs).alias("line"), key_hashes(_lines(docs)).alias("k"))
    keeps = F.filter(cut, lambda x: x["k"].isNull() | ~F.array_contains(drop, x["k"]))
    joined = docs.select(*held, F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias(doc)).join(drops, doc, "left")
    hit = F.col(drop).isNotNull()
    kept = joined.withColumn(cut, F.when(hit, lines)).withColumn(stay, F.when(hit, keeps))
    text = F.when(hit, F.array_join(F.col(stay)["line"], "\n")).otherwise(F.coalesce(F.col("text"), F.lit("")))
    total = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long")
    out = kept.withColumn("n_lines", total).withColumn(
        "n_dropped", F.when(hit, (F.size(cut) - F.size(stay)).cast("long")).otherwise(F.lit(0).cast("long"))
    ).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*held, "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM {docs})
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(o.owner <> l.doc_id, FALSE) AS gone
  FROM lines l LEFT JOIN owners o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
SQL = f"""
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({ORACLE.format(docs="documents")})
"""
