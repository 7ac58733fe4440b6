"""Licence scans by matching texts against templates with markup.

A template is licence wording with two kinds of markup: ``[[ ... ]]`` holds
words that may be missing, and ``{{n}}`` stands for up to n words of any kind
(names, years). It is compiled into a token automaton; a place in a text is
accepted when every mandatory word follows in the template's order, with
nothing between them but what the markup allows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import table

#: The phrases of the base scan and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Public licence wording, with markup, by label.
TEMPLATES = {
    "agpl-3.0": "[[this {{4}} is]] licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance "
    "with the license [[you may obtain a copy of the license at {{8}}]] unless required by applicable law or agreed to in "
    "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
    "kind either express or implied see the license for the specific language governing permissions and limitations under "
    "the license",
    "bsd-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution",
    "cc-by-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by [[license]] 4.0 [[international]] [[license]]",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa 4.0",
    "cc-by-attribution": "creative commons attribution {{3}} [[international]] license",
    "gpl-3.0": "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license [[v3]] version 3",
    "gpl-2.0": "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license version 2",
    "gpl-header": "free software you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version {{2}} of the license or at your option any later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "[[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not "
    "distributed with this file you can obtain one at",
    "proprietary": "[[copyright {{8}}]] all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

BASE_ONLY = 0.5
#: A-Z to lower case, other ASCII that is no digit or letter to a blank; bytes beyond ASCII stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n; per state the words that lead on, the states reached for nothing, and those reached by any word."""

    steps: tuple[tuple[bytes, int] | None, ...]
    empty: tuple[tuple[int, ...], ...]
    any_word: tuple[int | None, ...]
    mandatory: frozenset[bytes]

    def _closed(self, states: Iterable[int]) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.empty[s])
        return seen

    @functools.cached_property
    def firsts(self) -> frozenset[bytes]:
        return frozenset(self.steps[s][0] for s in self._closed([0]) if self.steps[s])

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        """The whole template stands from word ``at`` on."""
        final, states = len(self.steps) - 1, self._closed([0])
        while states and final not in states and at < len(words):
            moved = set()
            for s in states:
                if self.steps[s] and self.steps[s][0] == words[at]:
                    moved.add(self.steps[s][1])
                if self.any_word[s] is not None:
                    moved.add(self.any_word[s])
            states, at = self._closed(moved), at + 1
        return final in states


def compile_template(template: str) -> Automaton:
    """Words move one state on; an optional region may be passed over; a replaceable one is n states of any word."""
    steps, empty, any_word, mandatory, opened = [], [[]], [], set(), []

    def grow(step=None, wild=None):
        steps.append(step)
        any_word.append(wild)
        empty.append([])

    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            opened.append(len(steps))
        elif part == "]]":
            empty[opened.pop()].append(len(steps))
        elif part.startswith("{{"):
            first = len(steps)
            n = int(part[2:-2])
            for _ in range(n):
                grow(wild=len(steps) + 1)
            for s in range(first, first + n):
                empty[s].append(first + n)
        else:
            for word in words_of(part.encode()):
                grow(step=(word, len(steps) + 1))
                if not opened:
                    mandatory.add(word)
    steps.append(None)
    any_word.append(None)
    return Automaton(tuple(steps), tuple(map(tuple, empty)), tuple(any_word), frozenset(mandatory))


@functools.cache
def automata() -> dict[str, Automaton]:
    return {label: compile_template(t) for label, t in TEMPLATES.items()}


@dataclass(frozen=True)
class Scan:
    """Word count, places of base phrases as (first word, label), and templates accepted as (first word, label)."""

    n_words: int
    base: list[tuple[int, str]]
    matches: list[tuple[int, str]]

    @property
    def score(self) -> float:
        return 1.0 if self.matches else BASE_ONLY if self.base else 0.0


def scan(text: bytes) -> Scan:
    words = words_of(text)
    there, places, base, matches = set(words), {}, [], []

    def at(word: bytes) -> list[int]:
        if word not in places:
            places[word] = [i for i, w in enumerate(words) if w == word] if word in there else []
        return places[word]

    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        if there.issuperset(parts):
            base += [(i, label) for i in at(parts[0]) if words[i : i + len(parts)] == parts]
    for label, automaton in automata().items():
        if automaton.mandatory <= there:
            starts = sorted({i for word in automaton.firsts for i in at(word)})
            matches += [(i, label) for i in starts if automaton.accepts_at(words, i)]
    return Scan(len(words), sorted(base), sorted(matches))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and matches (arrays of start and label), score of every document.

    A null text is an empty one: no words, no labels, score 0. Null doc_ids stay
    null, repeated rows are scanned each, an empty table gives an empty table.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            scans = [scan(t.as_py() or b"") for t in batch.column("text")]
            rows = [[[{"start": i, "label": label} for i, label in found] for found in (s.base, s.matches)] for s in scans]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([s.n_words for s in scans], pa.int64()),
                "base": pa.array([r[0] for r in rows], place),
                "matches": pa.array([r[1] for r in rows], place),
                "score": pa.array([s.score for s in scans], pa.float64()),
            })

    places = "array<struct<start: bigint, label: string>>"
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, base {places}, matches {places}, score double")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: base phrases where they stand; a template adds its label."""
    found = scan_documents(table(spark, sf_dir, "documents"))
    starts = F.col("base.start")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base.label"), F.col("matches.label"))), ",").alias("labels"),
        "score",
    )
