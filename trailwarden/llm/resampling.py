"""Importance resampling towards a target distribution, on bit slices.

Every text is a bag of hashed word runs. The corpus and the target are summed
per bucket, and a bucket's gain is the rounded log ratio of the two. A text's
weight, the sum of gains over its features, comes out exactly from bit planes:
its counts become planes of one bit per bucket, the gains planes by sign, and
for each pair of planes the popcount of their AND counts towards a power of
two. A draw by weight plus hash-seeded Gumbel noise keeps the best share.

Tasks work on ranges of whole texts. Only the sums per bucket - ``BUCKETS``
numbers, whatever the corpus - come to the driver; the order of the draw is a
range-partitioned sort of narrow rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import saved, table
from trailwarden.llm.words import chunks, split_words
from trailwarden.operators.ranking import with_row_index

BUCKETS = 10_000
RUNS = 3
MIN_WORDS = 20
SHARE = 5  # per cent of the texts with enough words
SEED = 42
SCALE = 1000
#: What separates words once A-Z are in lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 4 << 20
#: Texts sliced into planes at a time.
SLICED = 256
LONGEST = 255


@functools.cache
def _shift_tables() -> np.ndarray:
    """Per length and byte of a checksum: what it becomes when that many bytes follow (CRC-32 is linear)."""
    values = np.arange(256, dtype=np.uint32)
    step = values.copy()
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    now = np.stack([values << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(LONGEST):
        now = (now >> np.uint32(8)) ^ step[now & 0xFF]
        out.append(now)
    return np.stack(out).reshape(-1)


def crc_followed(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums as they enter that of a longer text, with ``length`` bytes behind them."""
    tables, rest = _shift_tables(), length
    while True:
        base = np.minimum(rest, LONGEST).astype(np.int64) * 1024
        crc = (
            tables[base + (crc & 0xFF)] ^ tables[base + 256 + (crc >> np.uint32(8) & 0xFF)]
            ^ tables[base + 512 + (crc >> np.uint32(16) & 0xFF)] ^ tables[base + 768 + (crc >> np.uint32(24))]
        )
        rest = np.maximum(rest - LONGEST, 0)
        if not rest.any():
            return crc


def features(texts: pa.Array, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``runs`` words, and the words per text.

    Checksums of runs are put together from those of their words; no run is
    ever spelt out.
    """
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    index, words, counts = split_words(pc.replace_substring_regex(lower, NO_WORD, " "))
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    alone = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    blank = np.full(len(raw), zlib.crc32(b" "), np.uint32)
    behind = (crc_followed(blank, size) ^ alone if len(raw) else blank)[index]  # " word"
    size = size[index] + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    run = alone[index]
    owners, found = [owner], [run]
    for n in range(1, runs):
        run = crc_followed(run[:-1], size[n:]) ^ behind[n:]
        whole = owner[n:] == owner[:-n]
        owners.append(owner[n:][whole])
        found.append(run[whole])
    return np.concatenate(owners), np.concatenate(found) % np.uint32(buckets), counts


def _bucket_sums(batches: Iterable[pa.RecordBatch], runs: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        texts = batch.column(0)
        for low, high in chunks(texts, CHUNK_BYTES):
            total += np.bincount(features(texts.slice(low, high - low), runs, buckets)[1], minlength=buckets)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit.astype(np.int32)), "n": pa.array(total[hit])})


def bucket_sums(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket; a row per bucket hit."""
    parts = texts.select("text").mapInArrow(lambda b: _bucket_sums(b, runs, buckets), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(SCALE * ln of the smoothed ratio of target to corpus), a whole number per bucket."""
    size, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda k: (target.get(k, 0) + 1) * size / ((corpus.get(k, 0) + 1) * wanted)
    return np.array([math.floor(SCALE * math.log(ratio(k))) for k in range(buckets)], np.int64)


def planes(bits: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(padded, axis=1).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, the signed power of two that each stands for)."""
    rows, worth = [], []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            rows.append((size >> k & 1).astype(bool))
            worth.append(sign << k)
    return planes(np.array(rows, bool).reshape(len(rows), len(gain))), np.array(worth, np.int64)


def sliced_weights(owner: np.ndarray, bucket: np.ndarray, texts: int, sliced: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """Sum of gains over the features of each text, by AND, popcount and powers of two."""
    gain, worth = sliced
    held, times = np.unique(owner * buckets + bucket, return_counts=True)
    owner, bucket = np.divmod(held, buckets)
    out = np.zeros(texts, np.int64)
    for low in range(0, texts, SLICED):
        a, b = np.searchsorted(owner, [low, low + SLICED])
        rows, cols, n = owner[a:b] - low, bucket[a:b], times[a:b]
        for k in range(int(n.max(initial=0)).bit_length()):
            on = (n >> k & 1).astype(bool)
            hit, at = np.unique(rows[on], return_inverse=True)
            bits = np.zeros((len(hit), buckets), bool)
            bits[at, cols[on]] = True
            counts = planes(bits)
            for plane, value in zip(gain, worth):
                out[low + hit] += np.bitwise_count(counts & plane).sum(1, dtype=np.int64) * (value << k)
    return out


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every text."""
    buckets, sliced = len(gain), gain_planes(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low, high in chunks(texts, CHUNK_BYTES):
                owner, bucket, words = features(texts.slice(low, high - low), runs, buckets)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(low, high - low),
                    "n_words": pa.array(words.astype(np.int64)),
                    "n_features": pa.array(np.bincount(owner, minlength=high - low).astype(np.int64)),
                    "weight": pa.array(sliced_weights(owner, bucket, high - low, sliced, buckets)),
                })

    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(SCALE * noise), seeded by the id alone; rows without id share one value."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for what is not drawn.

    Null and empty texts have no features and weight 0. Equal scores go by
    doc_id, rows without one last; repeated rows are drawn each. An empty
    target is the even distribution; an empty table gives an empty table. Of
    ``docs`` only ``doc_id`` and ``text`` are read, of ``target`` only ``text``,
    so other columns may have any names.
    """
    sums = lambda frame: {r["bucket"]: r["n"] for r in bucket_sums(frame).collect()}  # noqa: E731  BUCKETS rows at most
    weighed = weigh(docs, gains(sums(docs), sums(target)))
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = saved(weighed.withColumns({"score": score, "eligible": F.col("n_words") >= min_words}), "resampling-scores")
    drawn = scored.where("eligible").count() * share // 100
    placed = with_row_index(scored, F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.when(F.col("row_index") < drawn, F.col("row_index") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), coalesce(text, '') FROM benchmark
), worded AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, id, array_to_string(w[i:i + n - 1], ' ') AS f
  FROM (SELECT side, id, w, n, unnest(range(1, len(w) + 2 - n)) AS i FROM worded, (VALUES (1), (2), (3)) AS sizes(n) WHERE len(w) >= n)
), counted AS (
  SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL
), crc_table AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) AS r(k))
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)), crc_table
), sums AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS t
  FROM counted JOIN hashed USING (f) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS ss, sum(t) AS tt FROM sums
), gain AS (
  SELECT bucket, floor({SCALE} * ln((t + 1)::DOUBLE * (ss + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (tt + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM sums, totals
), weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT x.id AS doc_id, len(w) >= {MIN_WORDS} AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || sha256('{SEED}:' || x.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded x LEFT JOIN weighed y ON x.id = y.id WHERE x.side = 'd'
), placed AS (
  SELECT *, row_number() OVER (ORDER BY eligible DESC, score DESC, doc_id) AS place, count(*) FILTER (WHERE eligible) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE} * n // 100 THEN place END AS rank FROM placed
"""
