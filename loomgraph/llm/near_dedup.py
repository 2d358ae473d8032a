"""MinHash near-duplicates with sequential Bayesian verification.

Exact copies (equal shingle sets) are grouped first and stand as one class.
Band keys of MinHash signatures give candidates; their signatures are compared
batch by batch and a pair is dropped as soon as the posterior probability of a
similarity at the threshold or above falls below the chosen miss probability;
survivors are verified on their full sets of shingles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vector
from ._common import broadcast_if_small, store
from .grouping import Reach, buckets, components, connect, packed_keys

MAX_BROADCAST = 500_000
#: Members of a bucket up to which all its pairs are candidates; copies share many buckets, so few pairs connect them.
SMALL = 8


@dataclass(frozen=True)
class MinHash:
    """40 bands of 6 hashes find a pair at similarity 0.8 but for 5 in a million, above it more surely."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    batch: int = 40
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@cache
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_231)
    return r.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def signature(grams: np.ndarray, n: int) -> np.ndarray:
    a, b = _factors(n)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * a + b).min(axis=0), out=out)
    return out


@cache
def least_matches(p: MinHash) -> tuple[tuple[int, int], ...]:
    """After so many hashes, so many must be equal for a pair to stay.

    With a uniform prior the share of equal hashes after m of n is
    Beta(m + 1, n - m + 1), and P(share >= t) = P(Binomial(n + 1, t) <= m).
    Compared are single bytes, of which unequal hashes share one in 256.
    """
    t, out = p.percent / 100, []
    t += (1 - t) / 256
    for n in [*range(p.batch, p.hashes, p.batch), p.hashes]:
        total, m = 0.0, -1
        while total < p.miss and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        out.append((n, m))
    return tuple(out)


def posterior_screen(p: MinHash):
    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        score = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
        alive, done = np.ones(score.shape, bool), 0
        for n, least in least_matches(p):
            for h in range(done, n):
                score += x[..., h] == y[..., h]
            done = n
            alive &= score >= least
            if not alive.any():
                break
        score[~alive] = -1
        return score

    return near


def _signed(p: MinHash):
    def run(batches):
        for batch in batches:
            for part in _vector.pieces(batch, "text"):
                n, prints, signs, screens = [], [], [], []
                for grams in _vector.shingles(*_vector.word_hashes(part.column("text")), p.words):
                    n.append(len(grams))
                    prints.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                    mins = signature(grams, p.hashes) if len(grams) else None
                    signs.append(_bands(mins, p).tobytes() if len(grams) else None)
                    screens.append(_vector.mix(mins.astype(np.uint64)).astype(np.uint8).tobytes() if len(grams) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary()), pa.array(screens, pa.binary())], ["doc_id", "n", "print", "bands", "sig"]
                )

    return run


def _sets(p: MinHash):
    """(id, grams) of the classes that the column ``chosen`` names by their prints."""

    def run(batches):
        for batch in batches:
            for part in _vector.pieces(batch, "text"):
                ids, sets = [], []
                for chosen, grams in zip(part.column("chosen").to_pylist(), _vector.shingles(*_vector.word_hashes(part.column("text")), p.words), strict=True):
                    data = grams.tobytes()
                    own = xxhash.xxh3_128_digest(data)
                    for c in chosen:
                        if c["print"] == own:
                            ids.append(c["id"])
                            sets.append(data)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "grams"])

    return run


def _bands(mins: np.ndarray, p: MinHash) -> np.ndarray:
    """A hash of each band."""
    rows = mins.reshape(p.bands, p.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(p.bands, dtype=np.uint64)
        for r in range(p.rows):
            key = _vector.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r] + np.uint64(1))
    return key


def _band_keys(p: MinHash):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            key = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64).reshape(len(batch), p.bands)
            keys = packed_keys(key, batch.column("n").to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), p.bands))], ["key", "id"])

    return run


def _linked(p: MinHash):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < p.percent * len(y):
                    ok.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                ok.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _grams(batches):
    """(id, gram, size) of every member of every set, and the set's size."""
    for batch in batches:
        for i, x in zip(batch.column("id").to_pylist(), batch.column("grams"), strict=True):
            grams = np.frombuffer(x.as_buffer(), np.int64)
            n = pa.array(np.full(len(grams), len(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, np.int64)), pa.array(grams), n], ["id", "gram", "size"])


def prefixes(sets: DataFrame, p: MinHash, owner: str = "") -> DataFrame:
    """(key, id, size, rest): the rarest shingles of each set, of which linked sets share one.

    Shingles are ordered by the number of sets that hold them. Two linked sets
    share at least ``percent / (100 + percent)`` of both sizes together; so
    both hold as many from the first shared one on, which is their ``rest``.
    Shingles of one set alone are left out; they only come first.
    """
    grams = store(sets.mapInArrow(_grams, "id long, gram long, size long"), "grams", owner)
    counts = store(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "gram-counts", owner)
    shared = grams.join(broadcast_if_small(counts, MAX_BROADCAST), "gram")
    rest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("m"), F.desc("gram"))).cast("long")
    ranked = shared.select(F.col("gram").alias("key"), "id", "size", rest.alias("rest"))
    return ranked.where(100 * F.col("rest") >= p.percent * F.col("size"))


def _prefixes_fit(p: MinHash):
    def fits(x, y):
        need = p.percent * (x["size"].to_numpy()[:, None] + y["size"].to_numpy()[None])
        return (100 + p.percent) * np.minimum(x["rest"].to_numpy()[:, None], y["rest"].to_numpy()[None]) >= need

    return fits


def near_duplicates(docs: DataFrame, p: MinHash = MinHash(), owner: str = "") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are separated by white space, A-Z lower-cased. A document without
    words, null or empty, is linked with nothing, nor is a row with a null id
    (its component is null and it is kept). Rows that share an id are versions
    of one document, linked where one of them is; repeated rows fare alike.
    Very long texts are taken whole. An empty table gives an empty one. Other
    columns are not looked at.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = store(slim.mapInArrow(_signed(p), "doc_id long, n long, print binary, bands binary, sig binary"), "signed", owner)
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes", owner)
    pairs, crowded = buckets(classes.select("id", "n", "bands").mapInArrow(_band_keys(p), "key long, id long"), Reach.of(p.percent / 100), SMALL, owner)
    wanted = store(pairs.select("a").union(pairs.select("b")).union(crowded.select("id")).distinct().select(F.col("a").alias("id")), "wanted", owner)
    wanted = broadcast_if_small(wanted, MAX_BROADCAST)
    signatures = store(classes.join(wanted, "id", "left_semi").select("doc_id", "print", "id", "sig"), "signatures", owner)
    chosen = store(signatures.groupBy("doc_id").agg(F.collect_list(F.struct("print", "id")).alias("chosen")), "chosen", owner)  # the texts of one document
    sets = store(slim.join(broadcast_if_small(chosen, MAX_BROADCAST), "doc_id").select("text", "chosen").mapInArrow(_sets(p), "id long, grams binary").dropDuplicates(["id"]), "sets", owner)

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_linked(p), "a long, b long")

    narrower = lambda ids: prefixes(sets.join(broadcast_if_small(ids, MAX_BROADCAST), "id", "left_semi"), p, owner)
    known = connect(pairs, crowded, signatures.select("id", "sig"), posterior_screen(p), verify, owner, narrower, _prefixes_fit(p))
    # rows with one id and different texts are linked through the id
    versions = full.select("doc_id", "print").distinct()
    several = versions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    extra = store(versions.join(several, "doc_id").join(classes.select("print", "id"), "print").select("doc_id", "id"), "versions", owner)
    if not extra.isEmpty():
        lead = extra.groupBy("doc_id").agg(F.min("id").alias("a"))
        known = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(extra.join(lead, "doc_id").select("a", F.col("id").alias("b"))), owner)
    member = classes.select("print", "id", "doc_id").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = member.where("component <> id").groupBy("component").agg(F.min("doc_id").alias("other"))
    least = member.where("component = id").join(least, "component", "left").select("component", F.least("doc_id", "other").alias("component_id"))
    class_of = member.join(least, "component").select("print", "component_id")
    return signed.join(class_of, "print", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, p: MinHash = MinHash(), owner: str = "") -> DataFrame:
    """The rows of ``docs`` whose document is the one kept of its component, columns unchanged."""
    found = near_duplicates(docs, p, owner).where("not kept").select(F.col("doc_id").alias("__lgn_id")).distinct()
    gone = broadcast_if_small(store(found, "gone", owner), MAX_BROADCAST)
    return docs.join(gone, docs["doc_id"] == gone["__lgn_id"], "left_anti")
