"""Near duplicates by one-permutation hashing with optimal densification.

Documents with the same set of shingles become one class first. A class's set
is hashed once; the hash's leading bits are the bin and the least hash in each
bin is kept. An empty bin copies the first filled one on a walk of its own over
all bins. Bands of bins are buckets.

Candidates are the members of a bucket against its smallest document, then what
that leaves apart: members of buckets that still hold several components. Those
of all buckets with the same largest component are a group, and its smallest
document the group's centre. A set is written as its difference to the centre's,
a short list in a group of near copies, and how much of it two similar sets must
share follows from the sizes. So only documents meet that share one of their
rarest differences; who is close to the centre needs one link to the closest
of all. No pair that shares a bucket and could join two components is passed
over, and a group of n near copies costs about n pairs, even if many of them
differ too much to be linked. Links are confirmed on whole sets. With 32 bands
of 4, a pair at the threshold shares no bucket with a probability of 5e-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailwarden.llm.common import BLANKS, folded, lacks, saved, table, unused
from trailwarden.llm.components import components
from trailwarden.llm.words import chunks

WIDTH = 5
SIMILARITY = 80  # per cent
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Classes of shingles, by hash, in the bound on how far two sets are apart.
CLASSES = 1024
#: Longer words are hashed one by one.
LONG_WORD = 256

_BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_ODD = (np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: For each bin the order in which it asks the others.
_WALKS = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])
_BAND_SALT = np.random.default_rng(11).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: For a word's last bytes: ones where they are.
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS.encode(), np.uint8))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text), A-Z in lower case; nulls have none. Words are what the six ASCII blanks separate."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(ends[-1] - ends[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # eight bytes more, since words are read by eights
    letters = np.zeros(size + 8, np.uint8)
    np.take(_LOWER, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], out=letters[:size])
    ends = ends - ends[0]
    inner = ~_BLANK[letters[: size + 1]]
    inner[size] = False
    cut = np.zeros(size + 1, bool)
    cut[ends] = True
    first = np.flatnonzero(inner & (cut | ~np.r_[False, inner[:-1]]))
    past = np.flatnonzero(inner[:-1] & (cut[1:] | ~inner[1:])) + 1
    left = past - first
    eights = np.ndarray(size + 1, "<u8", letters, strides=(1,))
    out = left.astype(np.uint64)
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(letters[first[i] : past[i]])
    some = np.flatnonzero(left <= LONG_WORD)
    at, left = first[some], left[some]
    while len(some):
        out[some] = _finish(out[some] * _ODD[0] + (eights[at] & _LAST[np.minimum(left, 8)]))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return out, np.diff(np.searchsorted(first, ends))


class ShingleHasher:
    """Sets of shingle hashes of whole texts."""

    def __init__(self, width: int) -> None:
        self.width = width

    def _fold(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(columns[0]), np.uint64(len(columns)))
        for k, column in enumerate(columns):
            out = out * _ODD[k % len(_ODD)] + column
        return _finish(out)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted different shingle hashes per text; no words, empty set."""
        hashes, counts = word_hashes(texts)
        n = len(hashes) - self.width + 1
        rolled = self._fold([hashes[k : k + n] for k in range(self.width)]) if n > 0 else hashes[:0]
        out, at = [], 0
        for count in counts.tolist():
            end = at + count
            if count >= self.width:
                out.append(np.unique(rolled[at : end - self.width + 1]))
            elif count:
                out.append(self._fold([hashes[k : k + 1] for k in range(at, end)]))
            else:
                out.append(hashes[:0])
            at = end
        return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One hash per bin of each of some sorted, not empty sets."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = owner * BINS + (values >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    out, filled = np.zeros(len(sets) * BINS, np.uint64), np.zeros(len(sets) * BINS, bool)
    out[places[first]], filled[places[first]] = values[first], True
    empty = np.flatnonzero(~filled)
    for step in range(BINS):
        if not len(empty):
            break
        asked = empty // BINS * BINS + _WALKS[empty % BINS, step]
        found = filled[asked]
        out[empty[found]] = out[asked[found]]
        empty = empty[~found]
    return out.reshape(len(sets), BINS)


def band_keys(sets: list[np.ndarray]) -> pa.Array:
    """The buckets of each set; an empty one has none."""
    offsets = np.cumsum([0, *(BANDS if len(s) else 0 for s in sets)]).astype(np.int32)
    full = [s for s in sets if len(s)]
    key = np.zeros((0, BANDS), np.uint64)
    if full:
        rows = sketches(full).reshape(len(full), BANDS, ROWS)
        key = np.tile(_BAND_SALT, (len(full), 1))
        for k in range(ROWS):
            key = key * _ODD[k] + rows[:, :, k]
        key = _finish(key)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.ravel().view(np.int64)))


def _digest(values: np.ndarray) -> tuple[int, int]:
    pair = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64)
    return int(pair[0]), int(pair[1])


def _sketched(width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in batches:
            texts = batch.column("text")
            for low, high in chunks(texts):
                sets = hasher.sets(texts.slice(low, high - low))
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(low, high - low),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": pa.array([d[0] for d in digests], pa.int64()),
                    "d2": pa.array([d[1] for d in digests], pa.int64()),
                    "bands": band_keys(sets),
                })
    return run


def _whole_sets(width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in batches:
            texts = batch.column("text")
            for low, high in chunks(texts):
                part = batch.slice(low, high - low)
                sets = hasher.sets(texts.slice(low, high - low))
                # a repeated doc_id may bring another class's text
                own = [_digest(s) == d for s, d in zip(sets, zip(part.column("d1").to_pylist(), part.column("d2").to_pylist()))]
                mask = pa.array(own, pa.bool_())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").filter(mask), part.column("d1").filter(mask),
                    pa.array([s.tobytes() for s, o in zip(sets, own) if o], pa.binary()),
                ], ["doc", "c", "set"])
    return run


def _confirm(similarity: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, linked = batch.column("left"), batch.column("right"), []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= similarity * (len(a) + len(b) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
    return run


def _links(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets are similar enough."""
    left = sets.select(F.col("doc").alias("b"), F.col("c").alias("bc"), F.col("set").alias("left"))
    right = sets.select(F.col("doc").alias("a"), F.col("c").alias("ac"), F.col("set").alias("right"))
    return edges.join(left, ["b", "bc"]).join(right, ["a", "ac"]).select("a", "b", "left", "right").mapInArrow(
        _confirm(similarity), "a long, b long"
    )


def _differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that either a set or that of its group's centre has, not both, in place of the two; and ``odd``,
    a bit for each class of hashes, set if an odd number of the set's shingles is in it."""
    for batch in batches:
        own, centre = batch.column("set"), batch.column("centre")
        for low, high in chunks(own):
            values = [np.setxor1d(*(np.frombuffer(x[i].as_buffer(), np.int64) for x in (own, centre)), assume_unique=True) for i in range(low, high)]
            offsets = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
            apart = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            counts = [np.bincount(np.frombuffer(own[i].as_buffer(), np.int64) & (CLASSES - 1), minlength=CLASSES) for i in range(low, high)]
            odd = [np.packbits(x & 1).view(np.int64) for x in counts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(low, high - low) for c in MEMBER), apart, pa.array(odd, pa.list_(pa.int64()))], [*MEMBER, "apart", "odd"])


#: Columns of a member of a group.
MEMBER = ["main", "doc", "c", "n", "component"]


def _across(members: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and pairs (a, ac, b, bc) still to confirm: together they join, in each group, what similar documents
    of different components can join.

    Of two sets that have x and y elements other than the centre and z of these in common, x + y - 2z are in one set
    only. Be ``w`` = (100 + similarity) * x - (100 - similarity) * n; the sets are similar enough exactly if the sum of
    both w is at most 2 * (100 + similarity) * z. So whoever needs nothing in common with some document needs nothing
    in common with the document of the least w, and is linked with that. Every other pair has a member that is not
    linked so, which bounds z from below for either side; with each side's elements in order, the rarest first, the
    first common one then is among the first x - z + 1. Classes that are odd in one of two sets only hold, each, a shingle
    that is in one of them only.
    """
    group, one = ["main"], ["main", "doc", "c"]
    mains = members.select(F.col("main").alias("doc")).distinct()
    centres = sets.join(mains, "doc").groupBy(F.col("doc").alias("main")).agg(F.min_by("set", "c").alias("centre"))
    apart = members.join(sets, ["doc", "c"]).join(saved(centres, "near-centres"), group, "left")
    apart = apart.select(*MEMBER, "set", F.coalesce("centre", F.expr("X''")).alias("centre"))
    apart = saved(apart.mapInArrow(_differences, "main long, doc long, c long, n long, component long, apart array<bigint>, odd array<bigint>"), "near-apart")

    whole, rest = 100 + similarity, 100 - similarity
    nodes = apart.select(*MEMBER, F.size("apart").alias("x")).withColumn("w", whole * F.col("x") - rest * F.col("n"))
    least = nodes.groupBy("main").agg(F.min(F.struct("w", "doc", "c")).alias("least"))
    nodes = saved(nodes.join(least, group).withColumn("outer", F.col("w") + F.col("least.w") > 0), "near-nodes")
    links = nodes.where("NOT outer AND doc <> least.doc").select(F.col("least.doc").alias("a"), F.col("doc").alias("b"))

    # what a document must have in common with any other, and with an outer one; sizes alone ask for as much as the last
    needs = lambda other: F.ceil((F.col("w") + other) / (2 * whole))
    by_size = F.ceil(F.col("x") - F.col("n") * rest / similarity)
    first = lambda z: F.col("x") - F.greatest(F.lit(1), z, by_size) + 1
    nodes = nodes.join(nodes.where("outer").groupBy("main").agg(F.min("w").alias("nearest")), group)
    nodes = nodes.select(
        *MEMBER, "x", "w", first(needs(F.col("nearest"))).alias("short"),
        F.when(F.col("outer"), first(needs(F.col("least.w")))).otherwise(0).alias("long"),
    ).where("short > 0 OR long > 0")
    nodes = saved(nodes, "near-nodes")

    each = apart.join(nodes.select(*one), one, "left_semi").select(*one, F.explode("apart").alias("e"))
    often = each.groupBy("main", "e").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy(*one)
    met = each.join(often, ["main", "e"]).select(
        *one, "e", F.row_number().over(own.orderBy("often", "e")).alias("rank"), F.count("*").over(own).alias("met"))
    # nobody else has the x - met elements that come before these
    met = met.join(nodes, one).withColumn("rank", F.col("rank") + F.col("x") - F.col("met"))
    met = saved(met.where(F.col("rank") <= F.greatest("short", "long")), "near-met")
    side = ["doc", "c", "n", "component", "x", "w", "met"]
    outer = met.where(F.col("rank") <= F.col("long")).select("main", "e", *(F.col(c).alias(f"o_{c}") for c in [*side, "rank"]))
    common = F.ceil((F.col("w") + F.col("o_w")) / (2 * whole))
    pairs = met.where(F.col("rank") <= F.col("short")).join(outer, ["main", "e"]).where(
        (F.col("component") != F.col("o_component")) & _sizes_allow("n", "o_n", similarity)
        & (F.col("rank") <= F.col("x") - common + 1) & (F.col("o_rank") <= F.col("o_x") - common + 1)
        & (common <= F.least("met", "o_met")))
    both = [*side, *(f"o_{c}" for c in side)]
    pairs = pairs.groupBy("main", *both).agg(F.count("*").alias("z"), F.max("rank").alias("last"), F.max("o_rank").alias("o_last"))
    pairs = pairs.where(common <= F.col("z") + F.least(F.col("x") - F.col("last"), F.col("o_x") - F.col("o_last")))
    odd = lambda other: apart.select(*(F.col(c).alias(f"{other}{c}" if c != "main" else c) for c in [*one, "odd"]))
    pairs = pairs.join(odd(""), one).join(odd("o_"), ["main", "o_doc", "o_c"])
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("o_odd", F.lit(k)))) for k in range(CLASSES // 64)))
    pairs = pairs.where(whole * differ <= rest * (F.col("n") + F.col("o_n")))
    # the smaller document first, so that a pair is one row however it was met
    ahead = (F.col("doc") < F.col("o_doc")) | ((F.col("doc") == F.col("o_doc")) & (F.col("c") < F.col("o_c")))
    sides = (("doc", "o_doc", "a"), ("c", "o_c", "ac"), ("o_doc", "doc", "b"), ("o_c", "c", "bc"))
    return links, pairs.select(*(F.when(ahead, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in sides)).distinct()


def _sizes_allow(a: str, b: str, similarity: int):
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def _near_links(docs: DataFrame, classes: DataFrame, sketched: DataFrame, width: int, similarity: int) -> DataFrame | None:
    """Confirmed links between documents that stand for different classes; None if no bucket is shared."""
    rows = sketched.join(classes, ["doc_id", "d1", "d2"], "left_semi")
    rows = rows.select(F.col("doc_id").alias("doc"), F.col("d1").alias("c"), "n", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct("doc", "c", "n")).alias("head"), F.max(F.struct("doc", "c")).alias("last")
    ).where("head.doc <> last.doc OR head.c <> last.c")
    heads = saved(heads.select("key", "size", F.col("head.doc").alias("a"), F.col("head.c").alias("ac"), F.col("head.n").alias("an")), "near-heads")
    shared = saved(rows.join(heads, "key"), "near-buckets")
    if lacks(shared):
        return None
    wanted = shared.select("doc", "c").distinct().join(classes.select(F.col("doc_id").alias("doc"), F.col("d1").alias("c"), "d2"), ["doc", "c"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    sets = saved(
        texts.join(wanted, "doc").select("doc", F.col("c").alias("d1"), "d2", "text").mapInArrow(_whole_sets(width), "doc long, c long, set binary"),
        "near-sets",
    )
    pair = ["a", "ac", "b", "bc"]
    named = shared.withColumnsRenamed({"doc": "b", "c": "bc"})
    edges = named.where(((F.col("a") != F.col("b")) | (F.col("ac") != F.col("bc"))) & _sizes_allow("an", "n", similarity))
    tested = saved(edges.select(*pair).distinct(), "near-pairs")
    links = saved(_links(tested, sets, similarity), "near-links")
    # in a bucket of two the only pair is tested
    of = components(links).withColumnRenamed("node", "doc")
    placed = shared.where("size > 2").select("key", "doc", "c", "n").join(of, "doc", "left")
    placed = saved(placed.withColumn("component", F.coalesce("component", "doc")), "near-placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("members", "component")).alias("top"))
    members = placed.join(mixed.where("parts > 1").select("key", F.col("top.component").alias("main")), "key")
    members = saved(members.select(*MEMBER).distinct(), "near-members")
    if lacks(members):
        return links
    close, fresh = _across(members, sets, similarity)
    fresh = saved(fresh.join(tested, pair, "left_anti"), "near-pairs")
    links = links.unionAll(close)
    return links if lacks(fresh) else links.unionAll(saved(_links(fresh, sets, similarity), "near-links"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Texts without words, null ones included, have no shingles and link with
    nothing; a text shorter than a shingle is one shingle. Rows that repeat a
    doc_id are one document: what any of its texts links with is linked. A row
    without doc_id links with nothing, has no component_id and is kept. An
    empty table gives an empty table.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = saved(source.mapInArrow(_sketched(width), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "near-sketched")
    known = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = saved(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")), "near-classes")
    links = _near_links(docs, classes, known, width, similarity)
    # documents whose rows lie in several classes tie those together
    several = known.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("doc_id")
    several = saved(several, "near-several")
    if not lacks(several):
        tied = known.join(several, "doc_id").select(F.col("doc_id").alias("a"), "d1", "d2")
        tied = tied.join(classes.withColumnRenamed("doc_id", "b"), ["d1", "d2"]).select("a", "b").where("a <> b")
        links = tied if links is None else links.unionAll(tied)
    placed = classes.withColumn("component_id", F.col("doc_id"))
    if links is not None:
        of = components(links).withColumnsRenamed({"node": "doc_id", "component": "found"})
        placed = classes.join(of, "doc_id", "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    placed = saved(placed.select("d1", "d2", "component_id"), "near-components")
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(placed, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """The documents that stand for their component, columns as they are.

    Of rows that share a doc_id and the words of their text one stays; so it
    does of rows without doc_id that share their words, which are compared with
    nothing else. Rows without words all stay, those of a document that goes
    excepted.
    """
    found = saved(near_duplicates(docs, width, similarity).select("doc_id", "kept"), "near-found")
    stays = docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    (of,) = unused(docs, "_of")
    again = saved(found.where("kept").groupBy(F.col("doc_id").alias(of)).count().where("count > 1").select(of), "near-again")
    if lacks(again):
        return stays
    words = F.filter(F.split(folded(F.coalesce(docs["text"], F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    same = F.col("doc_id").eqNullSafe(F.col(of))
    repeated = stays.join(again, same, "left_semi").withColumn(of, F.sha2(F.array_join(words, " "), 256))
    blank = F.col(of) == F.sha2(F.lit(""), 256)
    once = repeated.where(~blank).dropDuplicates(["doc_id", of]).unionAll(repeated.where(blank))
    return stays.join(again, same, "left_anti").unionAll(once.select(*docs.columns))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, s.b FROM reach r JOIN sides s ON r.seen = s.a
), least AS (
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
