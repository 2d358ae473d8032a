"""Whole Arrow batches of texts as flat NumPy arrays of word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are taken apart at a time; a longer text is a piece of its own.
PIECE = 4_000_000


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``size`` bytes at most."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_string(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.cast(texts, pa.large_string()), "")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(values: pa.Array, lower: bool = False) -> np.ndarray:
    """64-bit hashes of strings, with A-Z lower-cased if ``lower``; each distinct one is hashed once."""
    coded = pc.dictionary_encode(values)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(x.lower() if lower else x) for x in distinct), np.uint64, len(distinct))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, A-Z lower-cased, of all texts, and where each text's begin and end."""
    # pyarrow 23 garbles what ascii_lower makes of a slice that was cast, so distinct words are lower-cased instead
    lists = pc.ascii_split_whitespace(as_string(texts))
    values = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end of a text
        values = values.filter(pa.array(full))
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
    return hashed(values, lower=True), offsets


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words, but not none, has its whole sequence as the one shingle.
    """
    with np.errstate(over="ignore"):
        n = len(words)
        rolled = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(rolled)] + np.uint64(1))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
                yield h
            else:
                yield np.empty(0, np.uint64)
