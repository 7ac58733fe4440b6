"""Alignment of two tokenizers over the same texts.

Both tokenizers turn a text into consecutive byte ranges. Where a token of one
and a token of the other end at the same byte, the text can be cut; the cuts
make groups. ``align_ends`` finds them by skipping along a diagonal: while the
end arrays agree at the current index shift, tokens stand one to one, and
probes of doubling width jump such a stretch; where they disagree, the group is
resolved token by token up to the next common end, which sets a new shift.

No token of either vocabulary goes over a space between two other characters,
so such a space starts a *unit*. Tasks work on blocks of texts: the different
units of a block are laid end to end, tokenized and aligned once, and the texts
are put together from them. What the corpus has to say about a link comes back
to a block by one join of the block's different links with their counts, so a
link found in every text is one row per block.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import saved, table
from trailwarden.llm.packing import vocabulary_path
from trailwarden.llm.words import chunks

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text in a block, and units tokenized in one go. A block is one row, so its size is what tasks hold at once.
BLOCK_BYTES = 2 << 20
UNITS_AT_ONCE = 4096
#: A link as one number: A id times this plus B id.
RADIX = 1 << 24
#: From one token pair of a stretch to the next.
DIAGONAL = (1 << 32) + 1
#: Fixed value: the splitter of the byte-level vocabulary.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here both splitting libraries class all characters alike.
LATIN = "ɏ"


def align_ends(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Groups and one-to-one stretches of two ascending end arrays with an equal last entry.

    Returns irregular groups (first A, past A, first B, past B) and stretches
    (first A, first B, tokens); together, in order of A, they cover both.
    """
    groups, stretches, i, j, n = [], [], 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            run, step = 1, 1
            while step and i + run + step <= n and a[i + run : i + run + step] == b[j + run : j + run + step]:
                run, step = run + step, 2 * step
            while step > 1:  # the stretch ends inside the last probe
                step //= 2
                if i + run + step <= n and a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
            stretches.append((i, j, run))
            i, j = i + run, j + run
        else:
            p, q = i, j
            while a[p] != b[q]:
                if a[p] < b[q]:
                    p += 1
                else:
                    q += 1
            groups.append((i, p + 1, j, q + 1))
            i, j = p + 1, q + 1
    return groups, stretches


def overlaps(a: list[int], b: list[int], i: int, j: int, past: int) -> Iterator[int]:
    """Token pairs (A * 2 ** 32 + B) of one group, from (i, j) to A token ``past``, whose byte ranges overlap."""
    while i < past:
        yield i << 32 | j
        if a[i] < b[j]:
            i += 1
        elif a[i] > b[j]:
            j += 1
        else:
            i, j = i + 1, j + 1


@dataclass
class Aligned:
    """Units one after another: counts, links and the wording of groups of each; ``n_a`` is 0 where bytes got lost."""

    n_a: list[int] = field(default_factory=list)
    n_b: list[int] = field(default_factory=list)
    n_groups: list[int] = field(default_factory=list)
    n_links: list[int] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)


def byte_of_sign() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable bytes stand for themselves, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


class Aligner:
    """Both tokenizers, their token bytes, and the alignment of units."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_file)
        self.byte_level.encode_special_tokens = True
        special = set(self.byte_level.get_added_tokens_decoder())
        signs = byte_of_sign()
        vocabulary = {i: t for t, i in self.byte_level.get_vocab().items()}
        self.a_bytes = [
            vocabulary[i].encode() if i in special else bytes(signs[c] for c in vocabulary[i]) for i in range(len(vocabulary))
        ]
        # the same merges, as ranks, for the texts on which both libraries split alike
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _a(self, text: str) -> list[int]:
        spaced = " " + text
        if max(text) <= LATIN and text.replace("\n", "").isprintable():
            return self.fast.encode_ordinary(spaced)
        return self.byte_level.encode(spaced, add_special_tokens=False).ids

    def _learn(self, units: list[str], out: Aligned) -> None:
        text = " ".join(units)
        raw = b" " + text.encode()
        a_ids, b_ids = self._a(text), self.pieces.encode(text)
        whole = all(b"".join(map(names.__getitem__, ids)) == raw for names, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids)))
        if not whole:
            if len(units) > 1:  # look for the unit that lost bytes
                half = len(units) // 2
                self._learn(units[:half], out)
                self._learn(units[half:], out)
                return
            for column in (out.n_a, out.n_b, out.n_groups, out.n_links):
                column.append(0)
            out.links.append(np.zeros(0, np.int64))
            out.groups.append("")
            return
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        a, b, name = a_ends.tolist(), b_ends.tolist(), self.names
        irregular, stretches = align_ends(a, b)
        linked: list[int] = []
        # wording of the group that ends with a token of A
        wording: list[str | None] = [None] * len(a)
        for i, past, j, end in irregular:
            wording[past - 1] = f"{','.join([name[x] for x in a_ids[i:past]])}|{','.join([name[x] for x in b_ids[j:end]])}"
            linked.extend(overlaps(a, b, i, j, past))
        for i, j, run in stretches:
            wording[i : i + run] = [f"{name[x]}|{name[y]}" for x, y in zip(a_ids[i : i + run], b_ids[j : j + run])]
            first = i << 32 | j
            linked.extend(range(first, first + run * DIAGONAL, DIAGONAL))
        pairs = np.sort(np.array(linked, np.int64))
        of_a = pairs >> 32
        codes = np.array(a_ids, np.int64)[of_a] * RADIX + np.array(b_ids, np.int64)[pairs & 0xFFFFFFFF]
        upto = np.cumsum([len(u.encode()) + 1 for u in units])
        a_cuts = np.searchsorted(a_ends, upto, "right")
        b_cuts = np.searchsorted(b_ends, upto, "right")
        cuts = np.searchsorted(of_a, a_cuts)
        low_a = low_b = low = 0
        for high_a, high_b, high in zip(a_cuts.tolist(), b_cuts.tolist(), cuts.tolist()):
            found = [w for w in wording[low_a:high_a] if w is not None]
            out.n_a.append(high_a - low_a)
            out.n_b.append(high_b - low_b)
            out.n_groups.append(len(found))
            out.n_links.append(high - low)
            out.groups.append(";".join(found))
            low_a, low_b, low = high_a, high_b, high
        out.links.append(codes)

    def align(self, units: list[str], at_once: int = UNITS_AT_ONCE) -> Aligned:
        """Align units that neither start nor end with white space, or single texts of any kind if ``at_once`` is 1."""
        out = Aligned()
        for at in range(0, len(units), at_once):
            self._learn(units[at : at + at_once], out)
        return out


@functools.cache
def _aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def _texts_to_units(texts: pa.Array) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """(unit of each place, plain units, whole texts, places per text); whole texts are numbered after the plain units.

    A text with white space at one of its ends or beside a space is no sequence
    of plain units and counts as one unit. Null and empty texts have none.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    units = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = np.fromiter((bool(u) and u.strip() == u for u in units), bool, len(units))
    owner = np.repeat(np.arange(len(counts)), counts)
    odd = np.bincount(owner, ~plain[index], minlength=len(counts)) > 0
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(odd & ~empty)
    used, place = np.unique(index[~odd[owner]], return_inverse=True)
    sizes = np.where(odd, np.where(empty, 0, 1), counts)
    out = np.empty(sizes.sum(), np.int64)
    rest = np.repeat(~odd, sizes)
    out[rest], out[~rest] = place, len(used) + np.arange(len(whole))
    return out, [units[u] for u in used.tolist()], texts.take(pa.array(whole)).to_pylist(), sizes


BLOCK = (
    "block string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "sha256 array<string>, groups array<string>, places binary, sizes array<long>, unit_links binary, unit_sizes binary, "
    "links array<long>, times array<long>"
)


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _block(aligner: Aligner, doc_ids: pa.Array, texts: pa.Array, with_groups: bool) -> pa.RecordBatch:
    place, plain, whole, sizes = _texts_to_units(texts)
    parts = [aligner.align(plain), aligner.align(whole, 1)]
    count = lambda name: np.array([x for p in parts for x in getattr(p, name)], np.int64)
    n_a, unit_sizes = count("n_a"), count("n_links")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lost = np.bincount(owner, n_a[place] == 0, minlength=len(sizes)) > 0  # bytes differ: no tokens
    stays = ~lost[owner]
    place, sizes = place[stays], np.where(lost, 0, sizes)
    owner = owner[stays]
    total = lambda name: pa.array([np.bincount(owner, count(name)[place], minlength=len(sizes)).astype(np.int64)], pa.list_(pa.int64()))
    wording = [w for p in parts for w in p.groups]
    ends = np.cumsum(sizes)
    spelt, hashes = [], []
    for size, end in zip(sizes.tolist(), ends.tolist()):
        groups = ";".join([wording[u] for u in place[end - size : end].tolist()])
        hashes.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        if with_groups:  # several times as long as the text
            spelt.append(groups)
    links, slots = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for p in parts for x in p.links)]), return_inverse=True)
    seen = np.bincount(place, minlength=len(n_a))
    times = np.bincount(slots, np.repeat(seen, unit_sizes), minlength=len(links)).astype(np.int64)
    found = times > 0  # a unit may stand in lost texts alone
    slots = np.maximum(np.cumsum(found) - 1, 0)[slots]
    return pa.RecordBatch.from_pydict({
        "block": [uuid.uuid4().hex],
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        **{name: total(name) for name in ("n_a", "n_b", "n_groups", "n_links")},
        "sha256": [hashes],
        "groups": pa.array([spelt], pa.list_(pa.string())),
        "places": [_packed(place)],
        "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "unit_links": [_packed(slots)],
        "unit_sizes": [_packed(unit_sizes)],
        "links": pa.array([links[found]], pa.list_(pa.int64())),
        "times": pa.array([times[found]], pa.list_(pa.int64())),
    })


def _blocks(batches: Iterable[pa.RecordBatch], byte_name: str, piece_name: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(vocabulary_path(byte_name), vocabulary_path(piece_name))
    for batch in batches:
        for low, high in chunks(batch.column("text"), BLOCK_BYTES):
            # a call of its own, so that nothing of a block stays while the next one is made
            yield _block(aligner, *(batch.column(c).slice(low, high - low) for c in ("doc_id", "text")), with_groups)
        batch = None


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.cumsum(sizes)
    return ends[at] - ends[at - sizes]


def _documents(key, block: pa.Table, counted: pa.Table) -> pa.Table:
    row = {c: block.column(c)[0] for c in block.column_names}
    column = lambda name: row[name].values
    numbers = lambda name: _unpacked(row[name].as_py())
    slot = counted.column("slot").to_numpy()
    n, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    n[slot], best[slot] = counted.column("n").to_numpy(), counted.column("best").to_numpy()
    unit_links, unit_sizes, places = numbers("unit_links"), numbers("unit_sizes"), numbers("places")
    sizes = column("sizes").to_numpy()
    per_text = lambda values: pa.array(_sums(_sums(values[unit_links] if len(values) else np.zeros(len(unit_links), np.int64), unit_sizes)[places], sizes))
    groups = column("groups")
    return pa.table({
        "doc_id": column("doc_ids"), **{c: column(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
        "n_best": per_text(best), "count_sum": per_text(n), "groups_sha256": column("sha256"),
        "groups": groups if len(groups) else pa.nulls(len(sizes), pa.string()),
    })


def token_blocks(docs: DataFrame, byte_name: str = BYTE_VOCABULARY, piece_name: str = PIECE_VOCABULARY, with_groups: bool = False) -> DataFrame:
    """Aligned blocks of documents, a row each, written to the shared folder."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    return saved(source.mapInArrow(lambda batches: _blocks(batches, byte_name, piece_name, with_groups), BLOCK), "token-blocks")


def link_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, n (links corpus-wide) and best (whether no link of the B id is more frequent), a row per link."""
    rows = blocks.select(F.explode(F.arrays_zip("links", "times")).alias("x")).select("x.links", "x.times")
    counts = saved(rows.groupBy("links").agg(F.sum("times").alias("n")), "token-links")
    a_id, b_id = F.shiftright("links", 24).cast("int"), F.col("links").bitwiseAND(F.lit(RADIX - 1)).cast("int")
    named = counts.select("links", a_id.alias("a_id"), b_id.alias("b_id"), "n")
    highest = named.groupBy(F.col("b_id").alias("_b")).agg(F.max("n").alias("_most"))  # a row per id of the vocabulary at most
    return named.join(F.broadcast(highest), F.col("b_id") == F.col("_b")).select("links", "a_id", "b_id", "n", (F.col("n") == F.col("_most")).alias("best"))


def align_documents(docs: DataFrame, byte_name: str = BYTE_VOCABULARY, piece_name: str = PIECE_VOCABULARY, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups spelt out if wanted.

    Texts are tokenized with a space before them, without special tokens, whose
    strings inside a text are text. Null and empty texts, and those whose bytes
    a tokenizer does not give back, have no tokens: zeros and an empty string.
    Repeated rows and rows without doc_id are documents of their own and count
    in the corpus. Only ``doc_id`` and ``text`` are read, so other columns may
    have any names. An empty table gives an empty table.
    """
    blocks = token_blocks(docs, byte_name, piece_name, with_groups)
    counts = link_counts(blocks).select("links", "n", F.col("best").cast("int").alias("best"))
    wanted = blocks.select(F.col("block").alias("of_block"), F.posexplode("links").alias("slot", "links"))
    counted = wanted.join(counts, "links").select("of_block", "slot", "n", "best")
    kept = blocks.drop("links", "times")
    out = kept.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(
        _documents,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string",
    )
    return out if with_groups else out.drop("groups")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
