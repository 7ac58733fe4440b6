"""Exact top-k search by distributed histogram selection.

Queries come in blocks of a fixed size. For one block every task scores all its
candidates; the histograms of the scores, summed over all tasks, say in which
bin each query's kth value lies. The bin becomes the next round's range, until
it is one value wide. A last pass keeps what reaches the kth value; ties at it
are broken by the smaller id, of which every task passes on k at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailwarden.llm.common import saved, table

#: Queries scored together: what is broadcast, and what the driver holds, is this many vectors.
BLOCK = 4096
BINS_BITS = 7
SCALE = 256
#: Scores held at a time in a task.
TILE = 1 << 21
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 52)


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v) with v = floor(scale * x); vectors null, or with a null or non-finite component, are left out.

    Components beyond the range of a long are cut to it.
    """
    x = F.col(column)
    wide = F.transform(x, lambda c: c.cast("double"))
    fit = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    limit = float(1 << 62)
    whole = F.transform(wide, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-limit)), F.lit(limit))), F.lit(-(1 << 62))), F.lit(1 << 62)).cast("long"))
    return vectors.where(x.isNotNull() & F.col(key).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; what a shorter vector lacks counts as zero."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where those are exact, else in longs (modulo 2 ** 64)."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if bound < EXACT:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def _tiles(batches: Iterable[pa.RecordBatch], queries: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, candidate ids, which pairs are a query with itself) tile by tile."""
    step = max(1, TILE // max(1, len(ids)))
    for batch in batches:
        rows, own = _matrix(batch.column("v"), queries.shape[1]), batch.column("id").to_numpy()
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield _scores(queries, rows[at : at + step]), part, ids[:, None] == part[None, :]


def _histograms(queries: np.ndarray, ids: np.ndarray, low: np.ndarray, span: int, shift: int):
    """Counts of the scores from ``low`` on, ``span`` values wide, in bins of 2 ** shift values."""
    bins = 1 << BINS_BITS

    def run(batches):
        total = np.zeros(len(ids) * bins, np.int64)
        base = np.arange(len(ids))[:, None] * bins
        for scores, _, same in _tiles(batches, queries, ids):
            up = scores - low[:, None]
            keep = (up >= 0) & (up < span) & ~same
            total += np.bincount(((up >> shift) + base)[keep], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"q": pa.array(full // bins), "bin": pa.array(full % bins), "n": pa.array(total[full])})

    return run


def _reaching(queries: np.ndarray, ids: np.ndarray, kth: np.ndarray, k: int):
    """Candidates at or above the kth value; of those equal to it the k smallest ids of the task."""

    def run(batches):
        above, ties = [], {}
        for scores, own, same in _tiles(batches, queries, ids):
            q, c = np.nonzero((scores > kth[:, None]) & ~same)
            above.append((q, own[c], scores[q, c]))
            q, c = np.nonzero((scores == kth[:, None]) & ~same)
            order = np.lexsort((own[c], q))
            q, found = q[order], own[c][order]
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
            for a, b in zip(starts, [*starts[1:], len(q)]):
                ties[q[a]] = np.sort(np.r_[ties.get(q[a], found[:0]), found[a : min(b, a + k)]])[:k]
        for i, found in ties.items():
            above.append((np.full(len(found), i), found, np.full(len(found), kth[i])))
        if above:
            q, found, score = (np.concatenate(c) for c in zip(*above))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q]), "vec_id": pa.array(found), "score": pa.array(score.astype(np.int64))})

    return run


def _kth_values(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Each query's kth largest score, or the least there is if it has fewer candidates."""
    low = np.full(len(ids), -reach, np.int64)
    need = np.full(len(ids), k, np.int64)
    bits = (2 * reach + 1).bit_length()
    while bits > 0:
        shift = max(0, bits - BINS_BITS)
        counted = rows.mapInArrow(_histograms(queries, ids, low, 1 << bits, shift), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # beyond the kth value's bin nothing is needed: one row a query comes back
        above = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        target = rows.sparkSession.createDataFrame(list(zip(range(len(ids)), need.tolist())), "q long, need long")
        placed = counted.withColumn("above", above).join(F.broadcast(target), "q")  # one row a query of the block
        hit = placed.where(F.col("above") < F.col("need")).groupBy("q").agg(F.min(F.struct("bin", "above")).alias("s"))
        for q, bin_, over in hit.select("q", "s.bin", "s.above").collect():
            low[q] += bin_ << shift
            need[q] -= over
        bits = shift
    return low


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (id, v) of whole-number vectors.

    A query is never its own candidate. Vectors of unequal lengths are padded
    with zeros. Rows that repeat a query's id ask once; repeated candidates
    count as often as they occur. Queries with fewer than k candidates get
    them all; empty tables give an empty table.
    """
    spark = vectors.sparkSession
    rows = saved(vectors, "topk-rows")
    asked = saved(queries.dropDuplicates(["id"]), "topk-queries")
    width, peak = rows.agg(F.max(F.size("v")), F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()
    parts, after = [], None
    while True:
        rest = asked if after is None else asked.where(F.col("id") > after)
        part = rest.orderBy("id").limit(block).toArrow()
        if not part.num_rows:
            break
        ids = part.column("id").to_numpy()
        after = int(ids[-1])
        widest = max(width or 0, int(max((len(v) for v in part.column("v").to_pylist()), default=0)))
        matrix = _matrix(part.column("v").combine_chunks(), widest)
        reach = min(int(np.abs(matrix).max(initial=0)) * int(peak or 0) * widest, (1 << 62) - 1)
        kth = _kth_values(rows, matrix, ids, k, reach)
        parts.append(saved(rows.mapInArrow(_reaching(matrix, ids, kth, k), "query_id long, vec_id long, score long"), "topk-reaching"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("id") % 50 == 0), 5)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
