"""A quality classifier on random-indexing word vectors.

Each text is a stream of pairs: a word (lower case) and its shape (letters,
digits and signs as classes; a word that repeats the one before it has a shape
of its own). Both are hashed to a fixed number of ids. Every id has a sparse
random index vector; its word vector is the sum of the index vectors that stand
within two places of it, over all texts. Texts are pooled as the mean of their
normalised word vectors, and a two-layer network with a temperature, fitted on
a part of the sample that the weights never saw, gives the probability.

The table of word vectors has a fixed size (``ids`` by ``width``), whatever the
corpus; it is summed over all documents and sent to every task. Labels are
learned from a sample of at most ``sample`` labelled rows, those of the least
hashes of their ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vector

#: Ids in one row of a partial sum.
BLOCK = 512
#: Tokens whose vectors are looked up at a time.
SLICE = 200_000


@dataclass(frozen=True)
class Settings:
    ids: int = 1 << 15
    width: int = 32
    #: Entries of an index vector that are 1 or -1.
    nonzero: int = 2
    reach: int = 2
    hidden: int = 32
    #: Labelled rows that are learned from at most.
    sample: int = 20_000
    epochs: int = 60
    seed: int = 11


def stream(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words and shapes in turn, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(_vector.as_string(texts))
    values = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        values = values.filter(pa.array(full))
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
    coded = pc.dictionary_encode(values)
    at = coded.indices.to_numpy(zero_copy_only=False)
    lower = _vector.hashed(pc.utf8_lower(coded.dictionary))
    shape = coded.dictionary
    for pattern, mark in ((r"[0-9]+", "9"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "0"), (r"\p{Lu}{2,}", "2"), (r"\p{Lu}", "1")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    n = np.uint64(s.ids)
    out = np.empty(2 * len(at), np.int64)
    if len(at):
        words = lower[at]
        again = np.concatenate(([False], words[1:] == words[:-1]))
        with np.errstate(over="ignore"):
            shapes = _vector.mix(_vector.hashed(shape) + np.uint64(7919))
        out[0::2] = words % n
        out[1::2] = np.where(again, np.uint64(1), shapes[at] % n)
    return out, 2 * offsets


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every id's index vector."""
    r = np.random.default_rng(s.seed)
    return r.integers(0, s.width, (s.ids, s.nonzero)), r.choice(np.array([-1.0, 1.0]), (s.ids, s.nonzero))


def add_contexts(table: np.ndarray, ids: np.ndarray, offsets: np.ndarray, s: Settings, index=None) -> None:
    """Add to ``table`` (ids by width) the index vectors of the neighbours of every token, within its text."""
    place, sign = index or index_vectors(s)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for d in range(1, s.reach + 1):
        same = doc[d:] == doc[:-d]
        left, right = ids[:-d][same], ids[d:][same]
        for own, other in ((left, right), (right, left)):
            for k in range(s.nonzero):
                table += np.bincount(own * s.width + place[other, k], weights=sign[other, k], minlength=s.ids * s.width).reshape(s.ids, s.width)


def _partial(s: Settings):
    def run(batches):
        table, index, any_text = np.zeros((s.ids, s.width)), index_vectors(s), False
        for batch in batches:
            for part in _vector.pieces(batch, "text"):
                ids, offsets = stream(part.column("text"), s)
                if len(ids):
                    any_text = True
                    add_contexts(table, ids, offsets, s, index)
        if any_text:
            blocks = [table[i : i + BLOCK].astype("<i8").tobytes() for i in range(0, s.ids, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])

    return run


def _summed(batches):
    """Sums rows of one block as they come; a task holds one row for each block at most."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            x = np.frombuffer(sums.as_buffer(), "<i8")
            held[block] = held[block] + x if block in held else x
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, s: Settings) -> np.ndarray:
    """The normalised word vectors of all ids, from all of ``docs`` (column text)."""
    schema = "block int, sums binary"
    salt = F.pmod(F.spark_partition_id(), F.lit(32))
    part = docs.select("text").mapInArrow(_partial(s), schema).withColumn("salt", salt)
    part = part.repartition("block", "salt").select("block", "sums").mapInArrow(_summed, schema)
    table = np.zeros((s.ids, s.width))
    for block, sums in part.repartition("block").mapInArrow(_summed, schema).collect():  # a fixed number of rows of a fixed size
        x = np.frombuffer(sums, "<i8").reshape(-1, s.width)
        table[block * BLOCK : block * BLOCK + len(x)] += x
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """The mean vector of each text, and as a last column whether it has words."""
    ids, offsets = stream(texts, s)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((len(counts), s.width + 1), np.float64)
    for a in range(0, len(ids), SLICE):
        d = doc[a : a + SLICE]
        first = np.concatenate(([0], np.nonzero(d[1:] != d[:-1])[0] + 1))
        np.add.at(out[:, :-1], d[first], np.add.reduceat(vectors[ids[a : a + SLICE]], first, axis=0, dtype=np.float64))
    out[:, :-1] /= np.maximum(counts, 1)[:, None]
    out[:, -1] = counts > 0
    return out


@dataclass
class Network:
    """Two layers: tanh units, then one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-z))


def train(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Adam on four fifths of the rows; the temperature is the one of least log loss on the rest.

    Without rows every score is 0.5.
    """
    r = np.random.default_rng(s.seed)
    width = s.width + 1
    net = Network(np.zeros(width), np.ones(width), r.normal(0, width**-0.5, (width, s.hidden)), np.zeros(s.hidden), r.normal(0, s.hidden**-0.5, s.hidden), 0.0)
    if not len(y):
        net.w2[:] = 0
        return net
    order = r.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[used].mean(axis=0), np.maximum(x[used].std(axis=0), 1e-6)
    share = np.clip(y[used].mean(), 1e-3, 1 - 1e-3)
    net.b2 = float(np.log(share / (1 - share)))
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    z = (x - net.mean) / net.scale
    for epoch in range(s.epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / s.epochs))
        for batch in np.array_split(r.permutation(used), max(1, len(used) // 256)):
            h = np.tanh(z[batch] @ weights[0] + weights[1])
            g = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - y[batch]) / len(batch)
            gh = g[:, None] * weights[2] * (1 - h * h)
            step += 1
            for w, m, v, grad in zip(weights, first, second, (z[batch].T @ gh + 1e-4 * weights[0], gh.sum(axis=0), h.T @ g + 1e-4 * weights[2], np.array([g.sum()])), strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(held):
        logits = net.logits(x[held])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / t)))

        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(doc_id="doc_id"):
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, s: Settings) -> Network:
    """A network from the labelled rows that aren't held out; of several labels the largest counts, and null ones don't."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most s.sample ids

    def run(batches):
        for batch in batches:
            for part in _vector.pieces(batch, "text", 1_000_000):
                x = pooled(part.column("text"), vectors, s).astype("<f8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "x"])

    found = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary")
    found = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()  # one row for each of the sample
    x = np.array([np.frombuffer(r["x"], "<f8") for r in found]).reshape(-1, s.width + 1)
    return train(x, np.array([float(r["quality"] >= 1) for r in found]), s)


def score(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), cutoff: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the score of an empty vector.
    Repeated rows score alike. Other columns of the inputs are not looked at.
    """
    vectors = word_vectors(docs, s)
    net = fit(docs, labels, vectors, s)

    def run(batches):
        for batch in batches:
            for part in _vector.pieces(batch, "text", 1_000_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(net.scores(pooled(part.column("text"), vectors, s)))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
