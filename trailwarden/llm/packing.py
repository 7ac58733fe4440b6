"""Best-fit packing by minimum bin slack.

Only lengths matter for packing, and there are at most ``CAPACITY`` different
ones. So the documents are cut into pieces on the executors, the pieces are
counted by length, and the driver works out *recipes* from that histogram
alone: the longest piece left opens a bin, a subset-sum bit set over the
available lengths finds the fullest combination that fits beside it, and the
combination is taken as often as the histogram allows. Each time at least one
length runs short, so there are some thousand recipes at most, whatever the
size of the corpus. The pieces, numbered in order of length, then find their
bin and offset by arithmetic.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import saved, table
from trailwarden.llm.words import chunks, split_words
from trailwarden.operators.ranking import with_row_index

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
#: Words and pieces of words whose ids a task remembers, and the longest it does.
CACHE_WORDS = 450_000
CACHE_LENGTH = 48
#: Bytes of text tokenized at a time; ids and words of a larger part are what a task's memory goes to.
CHUNK_BYTES = 2 << 20
#: A letter and the ASCII mark behind it; U+0130 is left out, in lower case it ends in a mark of its own.
LETTER_THEN_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([!-/:-@\[-\x60{-~])"


class WordEncoder:
    """Ids of whole texts through ``tokenizers``, each different word once.

    The vocabulary's splitter never joins anything over white space nor over a
    letter and a mark behind it, and each piece it makes ends in exactly one
    token with the end-of-word mark. So words are remembered, and the new ones
    go to the tokenizer together.
    """

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"  # fixed: the splitter of the vocabulary file
    LATIN = "\u024f"

    def __init__(self, vocabulary: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(self.PIECE).findall
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.codes: dict[str, int] = {}
        self.words: list[str] = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _gather(self, code: np.ndarray) -> np.ndarray:
        """The ids of words, one word after another."""
        sizes = self.lengths[code]
        base = np.repeat(self.starts[code] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[base + np.arange(len(base))]

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.codes.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.words += words
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.used += len(ids)

    def _forget(self) -> None:
        """Keep the half of the words seen most often; the others are learnt again when they come."""
        kept = np.sort(np.argpartition(-self.seen, CACHE_WORDS // 2)[: CACHE_WORDS // 2])
        words, ids, lengths, seen = [self.words[k] for k in kept.tolist()], self._gather(kept), self.lengths[kept], self.seen[kept]
        self.codes, self.words, self.used = {}, [], 0
        self.starts, self.lengths, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._store(words, ids, lengths)
        self.seen = seen // 2

    def _learn(self, words: list[str]) -> None:
        """Tokenize new words in blocks; the end-of-word marks tell where each word ends."""
        block, pieces, rest = [], [], []
        for word in words:
            if len(word) > CACHE_LENGTH or (not word.isascii() and max(word) > self.LATIN):
                rest.append(word)
                continue
            if word.isalpha() and word.isascii():
                block.append(word)
                pieces.append(1)
            else:
                text = word if word.isascii() else unicodedata.normalize("NFC", word).lower()
                block.append(word)
                pieces.append(len(self.split(text)))
        for at in range(0, len(block), 4096):
            part = block[at : at + 4096]
            ids = np.array(self._whole(" ".join(part)), np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum(pieces[at : at + 4096])
            if len(cuts) == upto[-1]:
                self._store(part, ids, np.diff(cuts[upto - 1], prepend=0))
            else:  # a word that the splitter cuts differently when it stands alone
                rest += part
        if rest:
            ids = [self._whole(w) for w in rest]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._store(rest, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the separator after each text, and where each text ends."""
        # the splitter ends a piece there anyway, and "word," and "word." need not be learnt beside "word"
        index, words, counts = split_words(pc.replace_substring_regex(pc.fill_null(texts, ""), LETTER_THEN_MARK, r"\1 \2"))
        if len(self.codes) > CACHE_WORDS:
            self._forget()
        new = [w for w in words if w not in self.codes]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        self.seen[known] += np.bincount(index, minlength=len(words))
        code = known[index]
        ends = np.cumsum(self.lengths[code])
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.insert(self._gather(code), upto, np.uint32(SEPARATOR)), upto + np.arange(1, len(texts) + 1)


@functools.cache
def _encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(batches: Iterable[pa.RecordBatch], name: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(vocabulary_path(name))
    for batch in batches:
        doc_ids = batch.column("doc_id")
        texts = batch.column("text")
        for low, high in chunks(texts, CHUNK_BYTES):
            ids, ends = encoder.encode(texts.slice(low, high - low))
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sizes = ends - begins
            n = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(n)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (begins[owner] + start) * 4
            parts = [raw[a : a + 4 * k] for a, k in zip(at.tolist(), length.tolist())]
            columns = {
                "doc_id": doc_ids.slice(low, high - low).take(pa.array(owner)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32, and the ids if wanted."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(lambda batches: _cut(batches, vocabulary, capacity, with_ids), schema)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``, long ones preferred.

    Bit i of the set says that i can be filled. Lengths that may repeat enter
    as powers of two, so a length costs a few shifts however many there are.
    """
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, step = min(available[length], room // length), 1
        while left and not reach >> room & 1:
            step = min(step, left)
            trail.append((length, step, reach))
            reach |= (reach << (length * step)) & mask
            left, step = left - step, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, step, before in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + step
            total -= length * step
    return used


def recipes(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: pieces per bin}) that use the whole histogram up."""
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, bin_))
    return out


def _segments(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of piece numbers with one way of finding bin and offset: (first number, per bin, first bin, offset)."""
    base, taken = {}, 0
    for length in sorted(histogram):
        base[length] = taken
        taken += histogram[length]
    rows, first = [], 0
    for times, bin_ in recipes(histogram, capacity):
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.append((base[length], bin_[length], first, offset))
            base[length] += times * bin_[length]
            offset += length * bin_[length]
        first += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of pieces.

    Pieces of equal length are interchangeable; ties go by doc_id, piece and
    checksum, so reruns agree. Repeated rows are pieces of their own.
    """
    cut = saved(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, per_bin, bin_, offset = _segments(histogram, capacity)
    columns = cut.columns

    def place(batches):
        for batch in batches:
            number = batch.column("row_index").to_numpy()
            length = batch.column("length").to_numpy()
            k = np.searchsorted(first, number, "right") - 1
            nth = number - first[k]
            sequence, at = bin_[k] + nth // per_bin[k], offset[k] + nth % per_bin[k] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(at)], [*columns, "sequence_id", "offset"]
            )

    numbered = with_row_index(cut, "length", "doc_id", "piece", "ids_crc32")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return numbered.select(*columns, "row_index").mapInArrow(place, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` tokens and pack them.

    A null or empty text is one piece holding the separator. Null doc_ids are
    kept as they are. Repeated rows are packed as often as they occur. An empty
    table gives an empty table.
    """
    return pack(pieces(docs, vocabulary, capacity, with_ids), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
