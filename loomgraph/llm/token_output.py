"""Training-order materialisation of token ids in fixed-stride shards.

Texts become token ids, each closed by an end mark; the ids of an input
partition, in the order in which it is read, are cut into sequences of
``length`` ids, of which only a partition's last may be shorter. Sequences are
numbered through all partitions by a prefix sum of the partitions' counts. A
keyed Feistel network with cycle-walking permutes the numbers: the result is
the sequence's slot. Ranges of slots are shards, one file each, in which every
slot takes the same number of bytes, so that a reader can begin at any slot.

The slots of a run depend on the key, the input files and how Spark splits
them into partitions, not on timing: a task that runs again makes the same.

Shard: a header of 64 bytes (``LOOMTOK1``; then little-endian unsigned 64-bit:
first slot, slots, ids in a slot, slots in all, fingerprint of the key; zeros),
then for each slot the number of ids (32 bits) and ``length`` ids (16 bits),
the rest of which are the end mark.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _binary, _vector
from ._common import broadcast_if_small, free_shuffles, store

MAGIC = b"LOOMTOK1"
HEADER = 64
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits of that vocabulary: contractions, letters, digits, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Rows (a partition and its base) that may be broadcast.
MAX_BROADCAST = 500_000
#: Parts in which the sequences are shuffled one after the other, so that less of them is on disk at once.
SLICES = 2


@dataclass(frozen=True)
class Layout:
    length: int = 1024
    #: Slots of a shard: 8 MB of ids.
    per_shard: int = 4096
    #: Sequences of a row of the table of ids.
    per_run: int = 256
    #: Shards that one task writes.
    per_task: int = 4
    key: int = 0x5DEECE66D
    rounds: int = 6

    @property
    def stride(self) -> int:
        return 4 + 2 * self.length


class Permutation:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network on the next even number of bits, walked until it is below n."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh3_64_intdigest(struct.pack("<QQ", key % (1 << 64), r))) for r in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (_vector.mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (_vector.mix(right + k) & self.mask)
        return left << h | right

    def _walk(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x, np.uint64), keys, back)
            while (far := out >= np.uint64(self.n)).any():
                out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def number(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


class Tokens:
    """Byte-level ids of a vocabulary file."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN):
        self.path, self.pattern, self._encode = path, pattern, None
        self.end = len(Path(path).read_bytes().splitlines())

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "end": self.end, "_encode": None}

    def __call__(self, text: str) -> bytes:
        """The ids of a text, 16 bits each."""
        if self._encode is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(self.path).read_bytes().splitlines())}
            self._encode = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return np.array(self._encode(text), "<u2").tobytes()


def tokenised(docs: DataFrame, encode: Callable[[str], bytes], end: int, layout: Layout, owner: str = "") -> DataFrame:
    """Stored (part, first, n, ids): runs of whole sequences of a partition, packed; ``first`` is the number of the run's first one in it.

    Only a partition's last run may end within a sequence. Null and empty texts
    have no ids, not even an end mark.
    """
    size, mark = 2 * layout.length * layout.per_run, np.array([end], "<u2").tobytes()

    def run(batches):
        part, first, pack, held = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3), bytearray()

        def row(data: bytes):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(data) // 2], pa.int64()), pa.array([pack.compress(data)], pa.binary())], ["part", "first", "n", "ids"])

        for batch in batches:
            for piece in _vector.pieces(batch, "text", 2_000_000):
                for text in piece.column("text").to_pylist():
                    if text:
                        held += encode(text)
                        held += mark
                    while len(held) >= size:
                        yield row(bytes(held[:size]))
                        del held[:size]
                        first += layout.per_run
        if held:
            yield row(bytes(held))

    return store(docs.select("text").mapInArrow(run, "part int, first long, n long, ids binary"), "tokens", owner)


def materialise(docs: DataFrame, path: str, layout: Layout = Layout(), tokens: Tokens | None = None, owner: str = "") -> int:
    """Write the shards of the texts in ``docs`` below ``path``; the number of slots.

    Repeated rows are texts of their own; other columns are not looked at.
    Ids need 16 bits.
    """
    tokens = tokens or Tokens()
    if tokens.end >= 1 << 16:
        raise ValueError("the vocabulary has more ids than 16 bits hold")
    found = tokenised(docs, tokens, tokens.end, layout, owner)
    reached = F.max(F.col("first") + F.ceil(F.col("n") / F.lit(layout.length)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the scan
    bases = found.groupBy("part").agg(reached.alias("sequences")).withColumn("base", F.coalesce(F.sum("sequences").over(before), F.lit(0)))
    bases = store(bases, "bases", owner)
    slots = bases.agg(F.sum("sequences")).first()[0] or 0
    order, shards = Permutation(slots, layout.key, layout.rounds), -(-slots // layout.per_shard)
    width = 2 * layout.length

    def sequences(batches, low: int, high: int):
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for first, base, ids in zip(batch.column("first").to_pylist(), batch.column("base").to_pylist(), batch.column("ids"), strict=True):
                raw = unpack.decompress(ids.as_buffer())
                slot = order.slot(np.arange(base + first, base + first - (-len(raw) // width)))
                shard = slot // layout.per_shard
                own = np.flatnonzero((shard >= low) & (shard < high))
                data = [pack.compress(raw[i * width : (i + 1) * width]) for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard[own]), pa.array((slot[own] % layout.per_shard).astype(np.int32)), pa.array(data, pa.binary())], ["shard", "row", "data"])

    fingerprint = xxhash.xxh3_64_intdigest(struct.pack("<Q", layout.key % (1 << 64)))

    def shard_of(number: int, body: np.ndarray) -> pa.RecordBatch:
        head = MAGIC + struct.pack("<QQQQQ", number * layout.per_shard, len(body), layout.length, slots, fingerprint)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([head.ljust(HEADER, b"\0") + body.tobytes()], pa.binary())], ["shard", "data"])

    record = np.dtype([("n", "<u4"), ("ids", "<u2", (layout.length,))])

    def assemble(batches):
        number, body, unpack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            for shard, row, data in zip(batch.column("shard").to_pylist(), batch.column("row").to_pylist(), batch.column("data"), strict=True):
                if shard != number:
                    if number is not None:
                        yield shard_of(number, body)
                    number, body = shard, np.zeros(min(layout.per_shard, slots - shard * layout.per_shard), record)
                    body["ids"] = tokens.end
                ids = np.frombuffer(unpack.decompress(data.as_buffer()), "<u2")
                body["ids"][row, : len(ids)] = ids
                body["n"][row] = len(ids)
        if number is not None:
            yield shard_of(number, body)

    placed = found.join(broadcast_if_small(bases.select("part", "base"), MAX_BROADCAST), "part").select("first", "base", "ids")
    # slots are spread evenly, so equal ranges of shards are equal work
    ranges = max(1, -(-shards // layout.per_task))
    each = -(-ranges // SLICES)
    for start in range(0, ranges, each):
        low, high = start * layout.per_task, (start + each) * layout.per_task
        dealt = placed.mapInArrow(lambda batches, low=low, high=high: sequences(batches, low, high), "shard long, row int, data binary")
        dealt = dealt.repartitionById(min(each, ranges - start), (F.floor(F.col("shard") / layout.per_task) - start).cast("int")).sortWithinPartitions("shard")
        _binary.write_files(dealt.mapInArrow(assemble, "shard long, data binary"), path, by="shard", mode="append" if start else "error")
        free_shuffles(docs.sparkSession)
    return slots


def read_slots(spark: SparkSession, path: str, layout: Layout = Layout(), first: int = 0, count: int | None = None, packed: bool = False) -> DataFrame:
    """(slot, sequence, shard, n_tokens, token_ids) of ``count`` slots from ``first``; only their shards are read.

    ``sequence`` is the number that the permutation took to the slot. The
    header and length of each shard are checked. ``packed``: ids as bytes, 16
    bits each, instead of an array.
    """
    schema = "slot long, sequence long, shard long, n_tokens long, token_ids " + ("binary" if packed else "array<int>")
    last = None if count is None else first + count
    fingerprint = xxhash.xxh3_64_intdigest(struct.pack("<Q", layout.key % (1 << 64)))
    record = np.dtype([("n", "<u4"), ("ids", "<u2", (layout.length,))])

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                start, n, length, slots, key = struct.unpack("<QQQQQ", data[8:48])
                body = data[HEADER : HEADER + n * layout.stride]
                if bytes(data[:8]) != MAGIC or length != layout.length or key != fingerprint or start != int(shard) * layout.per_shard:
                    raise ValueError(f"shard {shard}: the header is another's")
                if len(body) != n * layout.stride or n != min(layout.per_shard, slots - start) or len(data) not in (HEADER + len(body), HEADER + len(body) + len(_binary.TRAILER)):
                    raise ValueError(f"shard {shard}: {len(data)} bytes do not hold {n} slots")
                rows, at = np.frombuffer(body, record), np.arange(start, start + n)
                order = Permutation(slots, layout.key, layout.rounds)
                for a in range(0, n, 1024):
                    keep = (at[a : a + 1024] >= first) & (at[a : a + 1024] < (last if last is not None else slots))
                    r, s = rows[a : a + 1024][keep], at[a : a + 1024][keep]
                    sizes = r["n"].astype(np.int64)
                    if packed:
                        lists = pa.array([x[: 2 * n].tobytes() for x, n in zip(np.ascontiguousarray(r["ids"]).view(np.uint8), sizes, strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(order.number(s)), pa.array(np.full(len(s), int(shard))), pa.array(sizes), lists], ["slot", "sequence", "shard", "n_tokens", "token_ids"])
                        continue
                    flat = r["ids"][np.arange(length)[None, :] < sizes[:, None]].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(order.number(s)), pa.array(np.full(len(s), int(shard))), pa.array(sizes), lists], ["slot", "sequence", "shard", "n_tokens", "token_ids"])

    files = _binary.read_files(spark, path)
    if "shard" not in files.columns:  # no shards
        return spark.createDataFrame([], schema)
    files = files.select(F.col("shard").cast("long").alias("shard"), "content").where(F.col("shard") >= first // layout.per_shard)
    if last is not None:
        files = files.where(F.col("shard") <= (last - 1) // layout.per_shard)
    return files.mapInArrow(run, schema)
