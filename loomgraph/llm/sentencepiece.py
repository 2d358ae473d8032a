"""Unigram tokenisation with SentencePiece vocabularies: Viterbi over a double-array trie.

The pieces and log scores come from a model file whose path is a parameter; it
is read on the driver and its tables travel to the executors with the task.
The best path maximises the sum of scores. A character that no piece covers
alone costs ten below the least score and becomes its UTF-8 bytes. Spaces are
written as the marker U+2581; a marker in the text itself is encoded as bytes,
so that decoding gives every text back exactly.
"""

from __future__ import annotations

import math
import re
import struct
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class DoubleArray:
    """A trie of byte strings in two arrays: from state s, byte c leads to t = base[s] + c + 1 if check[t] = s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-1], [-1]
        children: dict[int, dict[int, list]] = {}
        ordered = sorted(keys)
        todo = [(0, 0, len(ordered), 0)]
        free = dense = 1
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(ordered[lo]) == depth:
                self.value[state] = keys[ordered[lo]]
                lo += 1
            spans, i = [], lo
            while i < hi:
                c, j = ordered[i][depth], i
                while j < hi and ordered[j][depth] == c:
                    j += 1
                spans.append((c, i, j))
                i = j
            if not spans:
                continue
            first = spans[0][0]
            # states with several children search from where most places are taken; single ones fill the holes
            single = len(spans) == 1
            at = max(free if single else dense, first + 1)
            taken = tried = 0
            while True:
                if at >= len(self.check):
                    break
                tried += 1
                if self.check[at] == -1 and (single or all(at - first + c >= len(self.check) or self.check[at - first + c] == -1 for c, _, _ in spans[1:])):
                    break
                taken += self.check[at] != -1
                at += 1
            if single:
                free = at
            elif tried > 64 and taken >= 0.7 * tried or tried > 4096:
                dense = at
            b = at - first - 1
            grow = b + spans[-1][0] + 2 - len(self.check)
            if grow > 0:
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            self.base[state] = b
            for c, i, j in spans:
                self.check[b + c + 1] = state
                todo.append((b + c + 1, i, j, depth + 1))


class Model:
    """A vocabulary: pieces, log scores and kinds, by id."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.dummy_prefix, charsmap = True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
        if charsmap:
            raise ValueError("vocabularies with a normalisation table are not supported")
        self.byte_ids = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        if -1 in self.byte_ids:
            raise ValueError("the vocabulary has no byte pieces")
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.unknown_score, top = min(normal) - 10, max(normal)
        keys = {p.encode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.trie = DoubleArray(keys)
        self.scores = [len(p) * top - 0.1 if k == USER else s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        # a piece with a marker after another character, or with one of these characters, would reach over a cut
        whole = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)]
        self.cuts_at_space = not any(MARK in p.lstrip(MARK) for p in whole)
        used = set().union(*whole)
        apart = "".join(c for c in "\n\t\r\f\v" if c not in used)
        self.chunk_pattern = f"[{MARK}{apart}]| *[^ {MARK}{apart}]+| +" if self.cuts_at_space else f"{MARK}|[^{MARK}]+"
        self.output = [p.replace(MARK, " ").encode() if k in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Model:
        return cls(Path(path).read_bytes())

    @cached_property
    def _chunks(self):
        return re.compile(self.chunk_pattern).findall

    @cached_property
    def _cache(self) -> dict[str, list[int]]:
        return {}

    @cached_property
    def _check(self) -> list[int]:
        """Of the trie, with room for a step from any state."""
        return [*self.trie.check, *[-1] * (max(self.trie.base) + 258 - len(self.trie.check))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_chunks", "_cache", "_check")}

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation; of equal ones that with the longer last pieces."""
        if chunk == MARK:
            return [self.byte_ids[b] for b in MARK.encode()]
        data = chunk.replace(" ", MARK).encode()
        n, base, check, value, scores = len(data), self.trie.base, self._check, self.trie.value, self.scores
        steps = [c + 1 for c in data]
        best = [-math.inf] * (n + 1)
        back = [(0, 0)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            after = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            here, single, state, j = best[i], False, 0, i
            while j < n:
                t = base[state] + steps[j]
                if check[t] != state:
                    break
                state, piece = t, value[t]
                j += 1
                if piece >= 0:
                    s = here + scores[piece]
                    if s > best[j]:
                        best[j], back[j] = s, (i, piece)
                    if j == after:
                        single = True
            if not single:
                s = here + self.unknown_score
                if s > best[after]:
                    best[after], back[after] = s, (i, -1)
            i = after
        out = []
        while n:
            start, piece = back[n]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(data[start:n])]
            n = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Best segmentation of the whole text; it may be cut where no piece can reach over."""
        if not text:
            return []
        cache, ids = self._cache, []
        for chunk in self._chunks(" " + text if self.dummy_prefix else text):
            found = cache.get(chunk)
            if found is None:
                found = self.viterbi(chunk)
                if len(chunk) <= 48:
                    if len(cache) >= 200_000:
                        cache.clear()
                    cache[chunk] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _lists(ids: list[list[int] | None]) -> pa.ListArray:
    sizes = [len(x or ()) for x in ids]
    flat = np.fromiter(chain.from_iterable(x for x in ids if x), np.int32, sum(sizes))
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    nulls = np.array([*(x is None for x in ids), False])
    return pa.ListArray.from_arrays(pa.array(starts, mask=nulls), pa.array(flat))


def encode(docs: DataFrame, model: Model, text: str = "text", piece: int = 2_000_000) -> DataFrame:
    """Every row of ``docs`` without the text, plus ``token_ids``, ``n_tokens`` and ``round_trip``.

    ``round_trip`` tells that decoding the ids gave the text again. A null text
    has null ids and no tokens, an empty one an empty list; both come back as
    they were. Columns of ``docs`` with the names of the new ones are replaced.
    """
    others = [f for f in docs.schema.fields if f.name.lower() not in {text.lower(), "token_ids", "n_tokens", "round_trip"}]
    from pyspark.sql import types as T

    schema = T.StructType([*others, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    names = [f.name for f in others]

    def run(batches):
        from . import _vector

        for batch in batches:
            for part in _vector.pieces(batch, text, piece):
                ids, counts, same = [], [], []
                for t in part.column(text).to_pylist():
                    found = None if t is None else model.encode(t)
                    ids.append(found)
                    counts.append(len(found or ()))
                    same.append(t is None or model.decode(found) == t)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), _lists(ids), pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], [*names, "token_ids", "n_tokens", "round_trip"])

    return docs.select(*names, F.col(text)).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """Rows with ``token_ids`` as rows with ``text``; null ids give null."""
    from pyspark.sql import types as T

    names = [f.name for f in tokens.schema.fields if f.name != "token_ids"]
    schema = T.StructType([*(tokens.schema[n] for n in names), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return tokens.mapInArrow(run, schema)
