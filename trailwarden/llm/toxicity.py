"""Toxicity by weak supervision.

Voters (lexicons and patterns) fire or abstain on every document. A generative
label model, fitted by expectation maximisation to the counts of all vote
patterns in the corpus, estimates how often each voter fires on toxic and on
clean documents and how strongly voters agree beyond that; correlated voters
share their say. Its posteriors are the labels of a linear classifier, which
scores every document.

Human labels serve twice, and only those of rows outside the held-out third:
to find the words that mark toxic documents, and as the starting point of the
label model. Labels, lang, source and doc_id are no input of a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import saved, table
from trailwarden.llm.words import chunks

#: Rows of labelled text that lexicon and classifier are fitted on, lowest hashes first.
SAMPLE_ROWS = 20_000
#: Words the learnt lexicon may hold, and what a word must show to be in it.
LEXICON_WORDS = 512
MIN_SHARE = 0.01
MIN_TOXIC = 5
MIN_RATIO = 8.0
PREFIXES = (3, 4, 5, 6, 7, 8)
LEXICON_VOTERS = 6
ROUNDS = 60
THRESHOLD = 0.7
#: Bytes of text whose words are held at a time.
CHUNK_BYTES = 1 << 20

#: Insults in the four languages, in alphabetical order.
INSULTS = {
    "de": "abschaum arschloch dummkopf ekelhaft erbärmlich idiot nutzlos scheisse trottel versager widerlich wertlos",
    "en": "asshole bastard bitch clown disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid "
    "trash vermin worthless",
    "es": "asqueroso basura cabrón escoria estúpido idiota imbécil inútil miserable patético payaso perdedor",
    "fr": "abruti connard crétin débile dégoûtant idiot imbécile minable ordure pathétique pourriture stupide",
}
#: Signs that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!", "oieastasi")

LETTERS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"\b[^\W\d_]+\*{2,}[^\W\d_]*\b")
DISGUISED = re.compile(r"(?=\w*[0-9@$!])(?=[0-9@$!]*[^\W\d_])[\w@$!]{4,}")
ADDRESS = re.compile(r"\b(?:you|your|du|dein|tu|ton|eres|sois)\b\s+(?:are\s+|re\s+|bist\s+|es\s+)?(?:an?\s+|ein\s+|une?\s+)?([^\W\d_]+)", re.I)
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
PATTERN_VOTERS = ("insults", "disguised", "addressed", "stretched", "masked", "repeated", "often")
VOTERS = LEXICON_VOTERS + len(PATTERN_VOTERS)
KNOWN = frozenset(w for words in INSULTS.values() for w in words.split())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def marks_of(words: set[str]) -> set[str]:
    """Words and, for inflected and compounded forms, their beginnings with a hyphen."""
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


def words_of(text: str) -> set[str]:
    return marks_of(set(LETTERS.findall(text.lower())))


@dataclass
class Lexicon:
    """Learnt words and beginnings of words, strongest first; every voter has a sixth of them."""

    words: list[str]

    def __post_init__(self) -> None:
        self.index = {w: i for i, w in enumerate(self.words)}
        self.marks = self.index.keys() | KNOWN

    def votes(self, text: str) -> tuple[int, list[int]]:
        """Bits of the voters that fire, and the learnt words that occur."""
        lower = text.lower()
        words = set(LETTERS.findall(lower))
        found = sorted(self.index[w] for w in marks_of(words) & self.index.keys())
        bits = 0
        for i in found:
            bits |= 1 << i * LEXICON_VOTERS // len(self.words)
        hits = {w for w in words if marks_of({w}) & self.marks} if found else words & KNOWN
        disguised = {m.translate(DISGUISES) for m in DISGUISED.findall(lower)} if re.search(r"[0-9@$!]", lower) else set()
        fired = (
            bool(words & KNOWN),
            bool((disguised - words) & self.marks),
            bool(hits) and any(m in self.marks for m in ADDRESS.findall(lower)),
            any(STRETCHED.sub(r"\1", w) in self.marks for w in words - hits if STRETCHED.search(w)),
            bool(MASKED.search(text)),
            len(hits) > 1,
            len(hits) > 3,
        )
        for k, fires in enumerate(fired):
            bits |= fires << LEXICON_VOTERS + k
        return bits, found


def _digest(words: list[str]) -> int:
    """64 bits of a whole set of words: texts of the same words count once, however many rows there are."""
    return int.from_bytes(hashlib.sha256("\0".join(words).encode()).digest()[:8], "big", signed=True)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return saved(docs.select("doc_id", "text").join(chosen, "doc_id"), "toxic-training")


def learn_lexicon(training: DataFrame) -> Lexicon:
    """Words found in many toxic and almost no clean documents; texts of the same words count once."""

    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest(sorted(words_of(t or ""))), na_action=None)

    def tallies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(low, high - low)
                counts = (Counter(), Counter())
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    counts[toxic > 0].update(words_of(text or ""))  # with beginnings
                words = list(counts[0].keys() | counts[1].keys())
                columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in reversed(counts))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "bad", "good"])

    # rows of the same words are dropped before their words are spread, so that only counts are shuffled
    sketched = training.withColumn("sketch", F.pandas_udf(digests, "long")("text"))
    once = saved(sketched.select("sketch", "toxic", "text").dropDuplicates(["sketch", "toxic"]), "toxic-distinct")
    totals = dict(once.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Lexicon([])
    counts = once.select("toxic", "text").mapInArrow(tallies, "word string, bad long, good long")
    counts = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = (F.col("bad") / toxic) / ((F.col("good") + 0.5) / (clean + 1))
    best = counts.withColumn("ratio", ratio).where((F.col("bad") >= max(MIN_TOXIC, MIN_SHARE * toxic)) & (F.col("ratio") >= MIN_RATIO))
    chosen = best.orderBy(F.desc("bad"), F.desc("ratio"), "word").limit(LEXICON_WORDS)
    return Lexicon([r["word"] for r in chosen.orderBy(F.desc("ratio"), F.desc("bad"), "word").collect()])


def votes_of(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, list[list[int]]]:
    """Vote bits and learnt words of whole texts."""
    votes = [lexicon.votes(t) if t else (0, []) for t in texts.to_pylist()]
    return np.fromiter((v for v, _ in votes), np.int64, len(votes)), [f for _, f in votes]


def cast_votes(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """votes (bits) and found (learnt words) of every whole text, beside the columns to keep."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(low, high - low)
                bits, found = votes_of(part.column("text"), lexicon)
                columns = [part.column(k) for k in keep] + [pa.array(bits, pa.int32()), pa.array(found, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "votes", "found"])

    kept = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}votes int, found array<int>")


@dataclass
class LabelModel:
    """How often each voter fires on clean and toxic documents, and the weight that correlation leaves it."""

    prior: float
    fires: np.ndarray  # (2, voters)
    weight: np.ndarray  # (voters,)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = self.weight * np.log(self.fires[1] / self.fires[0])
        gone = self.weight * np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        odds = math.log(self.prior / (1 - self.prior)) + votes @ log + (1 - votes) @ gone
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, anchors: np.ndarray) -> LabelModel:
    """Expectation maximisation over vote patterns.

    ``anchors`` holds per pattern the clean and toxic training rows; they start
    the model and stay in it beside the unlabelled mass. After every round the
    correlation of voters within a class, given the posteriors, sets how much
    of its own evidence a voter keeps: 1 / (sum of its correlations).
    """
    votes = (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)
    seen = anchors.sum(0)
    prior = float(np.clip((seen[1] + 1) / (seen.sum() + 20), 0.005, 0.5))
    fires = np.clip((anchors.T @ votes + [[0.05], [0.5]]) / (seen[:, None] + 1), 1e-4, 1 - 1e-4)
    model = LabelModel(prior, fires, np.ones(VOTERS))
    free = np.maximum(counts - anchors.sum(1), 0)
    for _ in range(ROUNDS):
        toxic = model.posterior(votes)
        mass = np.stack([free * (1 - toxic) + anchors[:, 0], free * toxic + anchors[:, 1]])
        total = mass.sum(1)
        fires = np.clip((mass @ votes + [[0.05], [0.5]]) / (total[:, None] + 1), 1e-4, 1 - 1e-4)
        share = np.zeros(VOTERS)
        for k in (0, 1):
            off = votes - fires[k]
            cov = (off * mass[k][:, None]).T @ off / (total[k] + 1)
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.clip(cov / dev / dev[:, None], 0, 1)
            np.fill_diagonal(corr, 1)
            share += corr.sum(1) / 2
        weight = 1 / share
        done = np.allclose(fires, model.fires, atol=1e-6) and np.allclose(weight, model.weight, atol=1e-6)
        model = LabelModel(prior, fires, weight)
        if done:
            break
    return model


def _features(bits: np.ndarray, found: Iterable[Iterable[int]], words: int) -> np.ndarray:
    """Learnt words, voters, and a constant."""
    x = np.zeros((len(bits), words + VOTERS + 1), np.float32)
    for i, ks in enumerate(found):
        x[i, list(ks)] = 1
    x[:, words:-1] = bits[:, None] >> np.arange(VOTERS) & 1
    x[:, -1] = 1
    return x


def fit_classifier(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w = v = np.zeros(x.shape[1])
    if not len(x):
        return w
    rate = 4 / max(1.0, float(np.linalg.norm(x, 2) ** 2 / len(x)))
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        ahead = v - rate * (x.T @ (p - y) / len(x) + ridge * v)
        v, w = ahead + t / (t + 3) * (ahead - w), ahead
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray

    def score(self, bits: np.ndarray, found: Iterable[Iterable[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(_features(bits, found, len(self.lexicon.words)) @ self.weights)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the votes (row by row, with doc_id) of all documents it was fitted to.

    Votes are counted over the whole corpus; at most 2 ** VOTERS patterns reach
    the driver. Lexicon and classifier see at most ``rows`` labelled rows.
    """
    training = training_rows(docs, labels, rows)
    lexicon = learn_lexicon(training)
    voted = saved(cast_votes(docs, lexicon, "doc_id"), "toxic-votes")
    all_counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    sample = cast_votes(training, lexicon, "toxic").toPandas()  # at most ``rows`` rows
    patterns = np.array(sorted(all_counts.keys() | set(sample["votes"])) or [0], np.int64)
    at = {p: i for i, p in enumerate(patterns.tolist())}
    anchors = np.zeros((len(patterns), 2))
    np.add.at(anchors, ([at[v] for v in sample["votes"]], sample["toxic"].astype(int).clip(0, 1)), 1)
    counts = np.array([all_counts.get(p, 0) for p in patterns.tolist()], float)
    model = fit_label_model(patterns, counts, anchors)
    bits = sample["votes"].to_numpy(np.int64)
    soft = model.posterior((bits[:, None] >> np.arange(VOTERS) & 1).astype(float))
    weights = fit_classifier(_features(bits, sample["found"], len(lexicon.words)), soft)
    return ToxicityModel(lexicon, model, weights), voted


def _scores(rows: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = model.score(frame["votes"].to_numpy(np.int64), frame["found"])
            yield frame[list(keep)].assign(score=score.astype(float))

    kept = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return rows.mapInPandas(run, f"{kept}score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts take the score of a document on which no voter fires.
    A null doc_id is no training row. Repeated rows are scored each. Without
    labels the lexicon is empty and the fixed lists and patterns vote alone.
    An empty table gives an empty table.
    """
    model, voted = fit(docs, labels)
    scored = _scores(voted, model, "doc_id")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns as they are."""
    model, _ = fit(docs, labels)

    def verdicts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(low, high - low)
                scores = model.score(*votes_of(part.column("text"), model.lexicon))
                yield part.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(verdicts, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
