"""Words of many texts at once, each different word once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time.
CHUNK_BYTES = 6 << 20


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + size, "right")))
        yield low, high
        low = high


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of each word, different words, words per text), A-Z in lower case; nulls have none.

    Words are what the six ASCII blanks separate.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(filled, min_count=0).as_py():  # blanks at an end leave an empty word there
        owner = np.repeat(np.arange(len(counts)), counts)[filled.to_numpy(zero_copy_only=False)]
        counts, flat = np.bincount(owner, minlength=len(counts)), flat.filter(filled)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), counts
