"""Secret scans with a linear-chain conditional random field.

Tokens (runs without white space) are tagged begin, inside or outside. What a
token says depends on its shape, on the words beside it and on the file around
it; what two neighbours say depends on their tags. The field is trained here,
by gradient steps on the exact likelihood, on a bounded sample whose tags come
from the base patterns with the evidence of the keyword dropped at random, so
that shape, neighbours and keywords have to carry each other.

A word's shape and its pull on its neighbours are worked out once per word and
remembered. Tokens that no best path can tag as part of a secret - the score
against it exceeds all that the two transitions around it could give back -
are outside without further work; Viterbi runs over what remains.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import table

#: Documents the field is trained on: so many with a base span, and as many without, lowest hashes first.
SAMPLE_ROWS = 1500
WINDOW = 8  # tokens kept on both sides of a span, or of an odd-looking token, in training
WINDOWS = 6  # windows of a training text
STEPS = 60
DROPOUT = 0.3
CACHE_WORDS = 400_000
LABELS = ("O", "B", "I")

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"(?ai)pass(?:word|wd)|secret|token|api_?key")
KINDS = ("assign", "access", "hex", "crf")
MIN_VALUE = 6
MIN_ACCESS = 20
#: A tagged token shorter than this once trimmed is no secret; less is enough beside a cue.
MIN_TAGGED = 12
MIN_CUED = 6

#: Words that stand beside secrets, alphabetical.
CUES = frozenset("access api auth authorization aws basic bearer client credential credentials key login passphrase passwd password private pwd secret session sk token".split())
LETTERS_DIGITS = string.ascii_letters + string.digits
BASE64 = LETTERS_DIGITS + "+/"
UPPER_DIGITS = string.ascii_uppercase + string.digits
ASSIGNS = ("=", ":", ":=", "=>")
PUNCTUATION = ".,;:!?\"'()[]{}<>|"


def base_spans(text: str, keyword: bool = True, long: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping by kind, failing matches dropped.

    A caller who knows that no token has a keyword, or 24 characters, says so
    and saves the search for what then cannot be there.
    """
    spans = []
    if keyword:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if long:
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def in_order(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in in_order(spans))


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def names_cue(word: str) -> bool:
    """A cue or keyword, or one with a value assigned to it in the same token."""
    name = re.split("[=:]", word, maxsplit=1)[0].strip(PUNCTUATION).lower()
    return name in CUES or KEYWORD.search(name) is not None


def cue_beside(words: list[str], i: int) -> bool:
    """A cue stands in the token or before it, signs of assignment aside."""
    if re.search("[=:]", words[i]) and names_cue(words[i]):
        return True
    before = i - 1
    if before > 0 and words[before] in ASSIGNS:
        before -= 1
    return before >= 0 and names_cue(words[before])


def plain_shape(word: str) -> str:
    """The shape of a token of letters alone, punctuation around it aside; empty for all others."""
    bare = word if word.isalpha() else word.strip(PUNCTUATION)
    if not bare.isalpha() or len(bare) > 30:
        return ""
    case = "lower" if bare.islower() else "title" if bare[1:].islower() else "upper" if bare.isupper() else ""
    return f"{case}{min(len(bare) // 4, 6)}" if case else ""


def shape_features(word: str) -> list[str]:
    """What a token looks like."""
    bare = word.strip(PUNCTUATION)
    n, plain = len(bare), plain_shape(word)
    known = ["keyword"] if KEYWORD.search(bare) else ["cue"] if bare.lower() in CUES else []
    if plain or n < MIN_CUED:
        return ["bias", f"plain={plain}" if plain else f"short={n}", *known]
    upper, lower = sum(map(str.isupper, bare)), sum(map(str.islower, bare))
    digits = sum(map(str.isdigit, bare))
    kinds = (upper > 0) + (lower > 0) + (digits > 0)
    turns = sum((a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()) for a, b in zip(bare, bare[1:]))
    out = ["bias", f"length={min(n // 4, 10)}", *known]
    out += [f"kinds={kinds}", f"digits={min(5, digits * 10 // n)}", f"turns={min(5, turns * 10 // n)}", f"entropy={int(_entropy(bare))}"]
    if n >= 16 and not re.search(r"[^0-9a-fA-F]", bare):
        out.append("hex")
    if n >= 16 and kinds > 1 and not re.search(r"[^A-Za-z0-9+/=_-]", bare):
        out.append("base64")
    if re.search(r"[=:]", bare):
        out.append("assigned")
        if names_cue(bare):
            out.append("cue=")
    if bare.startswith("AKIA"):
        out.append("akia")
    if "://" in bare or bare.startswith("www."):
        out.append("url")
    if re.search(r"[^@]@[^@]+\.[A-Za-z]", bare):
        out.append("address")
    if digits and not upper + lower:
        out.append("number")
    return out


def neighbour_feature(word: str) -> str:
    """What a token tells the one beside it."""
    bare = re.sub(r"[^a-z_]", "", word.lower()[:40])
    if bare in CUES or KEYWORD.search(bare):
        return "cue" + ("=" if word[-1:] in "=:" else "")
    return "assign" if word in ASSIGNS else "ends" if word[-1:] in "=:" else "plain"


def file_features(words: list[str], text: str) -> list[str]:
    """What the document around tells every token: its share of signs and digits."""
    signs = sum(text.count(c) for c in "={};_/")
    return [f"signs={min(3, 100 * signs // max(1, len(text)))}", f"tokens={min(4, len(words).bit_length() // 3)}"]


def features(words: list[str], text: str) -> list[list[str]]:
    sides = [neighbour_feature(w) for w in words]
    whole = file_features(words, text)
    return [
        [*shape_features(w), *whole, *(["before:" + sides[i - 1]] if i else []), *(["after:" + sides[i + 1]] if i + 1 < len(words) else [])]
        for i, w in enumerate(words)
    ]


def silver_tags(text: str, tokens: list[tuple[int, int]]) -> list[int]:
    """Tags from the base spans: for assignments the value's part only."""
    marks = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE] if KEYWORD.search(text) else []
    marks += [(a, b) for a, b, kind in base_spans(text) if kind != "assign"]
    tags, last = [], False
    for start, end in tokens:
        hit = any(a < end and start < b for a, b in marks)
        tags.append((2 if last else 1) if hit else 0)
        last = hit
    return tags


@dataclass
class Field:
    """Weights of a linear-chain field: per feature and label, and per pair of labels."""

    names: dict[str, int]
    emit: np.ndarray  # (features, 3)
    move: np.ndarray  # (3, 3), from row to column

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for i, row in enumerate(rows):
            out[i] = self.emit[[self.names[f] for f in row if f in self.names]].sum(0)
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(windows: list[tuple[list[list[str]], list[int]]], seed: int = 0) -> Field:
    """Gradient steps on the regularised likelihood; windows of equal length go through forward and backward together."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in windows for row in rows for f in row}))}
    field = Field(names, np.zeros((len(names), 3)), np.zeros((3, 3)))
    groups: dict[int, list[int]] = {}
    for k, (rows, _) in enumerate(windows):
        groups.setdefault(len(rows), []).append(k)
    rng = np.random.default_rng(seed)
    prepared = []
    for n, members in sorted(groups.items()):
        width = max(len(row) for k in members for row in windows[k][0])
        index = np.full((len(members), n, width), len(names))
        for a, k in enumerate(members):
            for b, row in enumerate(windows[k][0]):
                index[a, b, : len(row)] = [names[f] for f in row]
        prepared.append((index, np.array([windows[k][1] for k in members])))
    total = sum(len(rows) for rows, _ in windows) or 1
    speed = [np.zeros((len(names) + 1, 3)), np.zeros((3, 3))]
    for _ in range(STEPS):
        grads = [np.zeros((len(names) + 1, 3)), np.zeros((3, 3))]
        weights = np.vstack([field.emit, np.zeros(3)])
        for index, tags in prepared:
            seen = np.where(rng.random(index.shape) < DROPOUT, len(names), index)
            seen[:, :, 0] = index[:, :, 0]
            scores = weights[seen].sum(2)
            n = scores.shape[1]
            forward = np.zeros_like(scores)
            backward = np.zeros_like(scores)
            forward[:, 0] = scores[:, 0]
            for t in range(1, n):
                forward[:, t] = scores[:, t] + _logsum(forward[:, t - 1, :, None] + field.move, 1)
            for t in range(n - 2, -1, -1):
                backward[:, t] = _logsum(field.move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            log_z = _logsum(forward[:, -1], 1)
            node = np.exp(forward + backward - log_z[:, None, None])
            gap = node - np.eye(3)[tags]
            np.add.at(grads[0], seen.reshape(-1), np.repeat(gap.reshape(-1, 3), seen.shape[2], 0))
            for t in range(1, n):
                pair = forward[:, t - 1, :, None] + field.move + (scores[:, t] + backward[:, t])[:, None, :]
                grads[1] += np.exp(pair - log_z[:, None, None]).sum(0)
                np.subtract.at(grads[1], (tags[:, t - 1], tags[:, t]), 1)
        for k, (weight, grad) in enumerate(((field.emit, grads[0][:-1] / total + 1e-4 * field.emit), (field.move, grads[1] / total + 1e-4 * field.move))):
            held = speed[k][: len(weight)]
            held += grad * grad
            weight -= 0.5 * grad / (np.sqrt(held) + 1e-8)
    return field


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best sequence of tags."""
    best, back = scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    tags = [int(best.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


class Tagger:
    """Tags whole texts; remembers what each word contributes.

    Words with the same features share a code, so there are few codes for
    millions of words.
    """

    SIDES = ("plain", "cue", "cue=", "assign", "ends")

    def __init__(self, field: Field) -> None:
        self.field = field
        self.slack = 2 * float(field.move.max() - field.move.min())
        weigh = lambda f: field.emit[field.names[f]] if f in field.names else np.zeros(3)
        self.before = np.array([weigh("before:" + s) for s in self.SIDES])
        self.after = np.array([weigh("after:" + s) for s in self.SIDES])
        self.words: dict[str, int] = {}
        self.codes: dict[tuple, int] = {}
        self.rows: list[tuple] = []  # per code: own scores, side, keyword, 24 characters
        self.known = 0

    def _code(self, word: str) -> int:
        side, keyword, long = neighbour_feature(word), KEYWORD.search(word) is not None, len(word) >= 24
        plain = "" if keyword else plain_shape(word)
        shape = (plain, word.strip(PUNCTUATION).lower() in CUES) if plain else tuple(shape_features(word))
        key = (shape, side, keyword, long)
        code = self.codes.get(key)
        if code is None:
            code = self.codes[key] = len(self.rows)
            self.rows.append((self.field.scores([shape_features(word)])[0], self.SIDES.index(side), keyword, long))
        return code

    def _learn(self, words: Iterable[str]) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        for word in words:
            self.words[word] = self._code(word)
        if len(self.rows) > self.known:
            own, side, keyword, long = zip(*self.rows)
            self.own, self.side = np.array(own), np.array(side)
            self.keyword, self.long, self.known = np.array(keyword), np.array(long), len(self.rows)

    def look_up(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.words)
        if new:
            self._learn(set(words) if len(self.words) > CACHE_WORDS else new)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def tag(self, text: str, words: list[str], code: np.ndarray) -> dict[int, int]:
        """{token: tag} of the tokens that are not outside."""
        out: dict[int, int] = {}
        if not words:
            return out
        side = self.side[code]
        scores = self.own[code] + self.field.scores([file_features(words, text)])[0]
        scores[1:] += self.before[side[:-1]]
        scores[:-1] += self.after[side[1:]]
        unsure = np.flatnonzero(scores[:, 0] - np.maximum(scores[:, 1], scores[:, 2]) <= self.slack)
        if not len(unsure):
            return out
        move = self.field.move
        for run in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
            low, high = int(run[0]), int(run[-1]) + 1
            piece = scores[low:high].copy()
            if low:
                piece[0] += move[0]  # what stands before is outside
            if high < len(words):
                piece[-1] += move[:, 0]
            out.update((low + i, t) for i, t in enumerate(viterbi(piece, move)) if t)
        return out


TOKEN = re.compile(r"\S+")


def tagged_spans(text: str, tags: dict[int, int]) -> list[tuple[int, int, str]]:
    """Spans of tagged tokens, trimmed of punctuation; inside tags go on from the token before."""
    if not tags:
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    spans, last = [], None
    for i in sorted(tags):
        start, end = places[i]
        if tags[i] == 2 and last == i - 1 and spans:
            spans[-1][1] = end
        else:
            spans.append([start, end, i])
        last = i
    out = []
    for start, end, first in spans:
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip(PUNCTUATION))
        end -= len(piece) - len(piece.rstrip(PUNCTUATION))
        if end - start >= MIN_TAGGED or (end - start >= MIN_CUED and cue_beside([text[a:b] for a, b in places[max(0, first - 2) : first + 1]], min(first, 2))):
            out.append((start, end, "crf"))
    return out


def find_secrets(text: str, tagger: Tagger) -> tuple[list, list]:
    """Base spans, and those the field adds where no base span lies."""
    words = TOKEN.findall(text)
    if not words:
        return [], []
    code = tagger.look_up(words)
    base = base_spans(text, tagger.keyword[code].any(), tagger.long[code].any())
    more = tagged_spans(text, tagger.tag(text, words, code))
    return base, [s for s in more if not any(a < s[1] and s[0] < b for a, b, _ in base)]


def _invented(rng: random.Random) -> str:
    """A value of a kind the sample may lack."""
    alphabet, low, high = rng.choice((
        (BASE64, 24, 64), (LETTERS_DIGITS, 20, 48), (LETTERS_DIGITS + "-_", 24, 40), (UPPER_DIGITS, 16, 24),
        (LETTERS_DIGITS, MIN_CUED, 11), (LETTERS_DIGITS + "!#$%@_-", MIN_CUED, 16)))
    value = "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    return "AKIA" + value[:16] if alphabet is UPPER_DIGITS else value


def _inserted(rng: random.Random, cues: list[str], words: list[str]) -> tuple[list[str], list[int]]:
    """Words with their tags to put into a text: a cue with an invented value, or one with none."""
    cue, sign, quote = rng.choice(cues), rng.choice(("", ":", "=")), rng.choice(("", "", '"', "'"))
    if rng.random() < 0.5:  # what follows is a word of the text, or a number; or a word is odd without a cue
        number, kind = str(rng.randrange(10 ** rng.randint(1, 8))), rng.randrange(4)
        if kind == 3:
            return [rng.choice(words) + number + rng.choice(("", f".{number}@{rng.choice(words)}.com"))], [0]
        return ([cue + sign, number], [0, 0]) if kind == 2 else ([cue + sign], [0])
    value = quote + _invented(rng) + quote
    form = rng.randrange(3)
    if form == 0:
        return [cue + rng.choice("=:") + value], [1]
    if form == 1:
        return [cue, rng.choice(ASSIGNS), value], [0, 0, 1]
    return [cue + sign, value], [0, 1]


def _unsure(words: list[str], tags: list[int]) -> list[bool]:
    """Tokens that may be secrets although no base pattern says so: letters with digits beside a cue."""
    mixed = [not t and len(w) >= MIN_CUED and any(map(str.isdigit, w)) and any(map(str.isalpha, w)) for w, t in zip(words, tags)]
    return [m and cue_beside(words, i) for i, m in enumerate(mixed)]


def _training_windows(texts: Iterable[str], seed: int = 0) -> list[tuple[list[list[str]], list[int]]]:
    """Windows around base spans, odd-looking tokens and cues, and at the start.

    Every window around a base span comes a second time with an invented value,
    usual passwords included, in its place and another cue before it, so that the field learns what a
    secret is like and not just the kinds that the sample happens to hold. Into
    every text a cue is put, half of the time with an invented value, so that
    the field learns both from samples with few base spans. Windows end at
    tokens of the sample that may be secrets without a base span: they teach
    neither label, however many texts hold such.
    """
    out, rng = [], random.Random(seed)

    def add(words: list[str], tags: list[int], i: int, text: str, unsure: list[bool]) -> None:
        low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        if any(unsure[i : i + 1]):
            return
        low = max([low, *(k + 1 for k in range(low, min(i, high)) if unsure[k])])
        high = min([high, *(k for k in range(i + 1, high) if unsure[k])])
        rows = features(words[max(0, low - 1) : high + 1], text)[low - max(0, low - 1) :][: high - low]
        if rows:
            out.append((rows, tags[low:high]))

    cues = sorted(CUES)
    for text in texts:
        places = [m.span() for m in TOKEN.finditer(text)]
        if not places:
            continue
        words, tags = [text[a:b] for a, b in places], silver_tags(text, places)
        unsure = _unsure(words, tags)
        hits = [i for i, t in enumerate(tags) if t == 1]
        odd = [i for i, w in enumerate(words) if not tags[i] and (len(w) > 14 or any(map(str.isdigit, w)))]
        cued = [i for i, w in enumerate(words) if not tags[i] and w.strip(PUNCTUATION).lower() in CUES]
        for i in [*hits[:WINDOWS], *odd[:WINDOWS], *cued[:WINDOWS], WINDOW]:
            add(words, tags, i, text, unsure)
        for i in hits[:WINDOWS]:
            other = list(words)
            quote = rng.choice(("", '"', "'"))
            other[i] = quote + _invented(rng) + quote
            for k in range(max(0, i - 2), i):
                if KEYWORD.search(other[k]):
                    other[k] = rng.choice(cues) + rng.choice(("", "", ":", "="))
            add(other, tags, i, text, unsure)
        at = rng.randrange(len(words) + 1)
        more, marks = _inserted(rng, cues, words)
        add(words[:at] + more + words[at:], tags[:at] + marks + tags[at:], at, text, unsure[:at] + [False] * len(more) + unsure[at:])
    return out


def training_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most ``rows`` texts with a base span and as many without; whole texts, lowest hashes first."""
    text = F.col("text")
    has = text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]") | text.rlike("AKIA[A-Z0-9]{16}") | text.rlike("[0-9a-f]{24}")
    known = docs.where(text.isNotNull()).select("text", has.alias("has"), F.xxhash64("text").alias("h"))

    def pick(flag: bool) -> list[str]:
        mine = known.where(F.col("has") == flag)
        # the bound first, on hashes alone: no task sends texts that are not chosen
        last = mine.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        if last is None:
            return []
        chosen = mine.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))
        return [r["text"] for r in chosen.orderBy("h").collect()]

    return pick(True), pick(False)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    having, lacking = training_texts(docs, rows)
    windows = _training_windows(having) + _training_windows(lacking)
    return train(windows or [([["bias"]], [0])])


@functools.cache
def _tagger(key: bytes) -> Tagger:
    import pickle

    return Tagger(pickle.loads(key))


def scan_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans (start, end, kind in code points) of every whole text.

    A null text is an empty one without spans. Null doc_ids stay null, repeated
    rows are scanned each, an empty table gives an empty table.
    """
    import pickle

    key = pickle.dumps(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(key)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                base, more = find_secrets(text.as_py() or "", tagger)
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in in_order([*base, *more])])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(found, kind)})

    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(run, "doc_id long, spans array<struct<start: bigint, end: bigint, kind: string>>")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_documents(docs, fit(docs.select("text")))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
