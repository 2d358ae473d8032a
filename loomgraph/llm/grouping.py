"""Linking rows within buckets and connected components, without all pairs.

Nothing here is gathered on the driver but counts; every round is cut by a
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_shuffles, release, store

#: Members of a bucket that one task compares with as many others.
CHUNK = 512
#: Members of a whole bucket that one task holds with their texts; larger ones are dealt by pairs of parts of so many.
PART = 2048
#: Slices of the crowded buckets whose members' texts are shuffled one after the other, so that less of them is on disk at once.
SLICES = 4
#: Entries are dealt by ranges of their keys, by so many high bits, and packed so many at a time.
RANGE_BITS, PACK = 12, 250_000
#: Pairs of signatures, and of keys, that are held against each other at a time.
PAIRS, CELLS = 20_000, 250_000
#: A key's low bits: its owner's size, as a number of steps of so much, and above them the place of what gave the key.
SIZE_BITS, PLACE_BITS, SIZE_STEP = 10, 6, 1.0125
LOW_BITS = SIZE_BITS + PLACE_BITS
#: Rounds of contraction to the least neighbour; later ones take the least hash, as chains of rising ids would shrink by one a round.
PLAIN_ROUNDS = 4
#: Edges that one task joins by itself; more are contracted in rounds until so few are left.
FEW_EDGES = 10_000


def _joined(batches):
    """Union-find over at most ``FEW_EDGES`` edges."""
    of: dict[int, int] = {}

    def root(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            of.setdefault(a, a)
            of.setdefault(b, b)
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int64()), pa.array([root(i) for i in of], pa.int64())], ["u", "l"])


def components(edges: DataFrame, owner: str = "") -> DataFrame:
    """Stored (id, component) for every id in ``edges`` (a, b); the component is its least id.

    Each round contracts every id to its least neighbour and keeps the edges
    that still join two; stars, which copies make, are gone after one or two.
    """
    at = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", owner)
    rounds = []
    while at.limit(FEW_EDGES + 1).count() > FEW_EDGES:
        ends = at.select(F.col("a").alias("u"), F.col("b").alias("v")).union(at.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if len(rounds) < PLAIN_ROUNDS:
            to = F.least("u", F.min("v"))
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("i"))
            to = F.least(rank("u"), F.min(rank("v")))["i"]
        rounds.append(store(ends.groupBy("u").agg(to.alias("l")), "labels", owner))
        la, lb = (rounds[-1].select(F.col("u").alias(k), F.col("l").alias(f"l{k}")) for k in "ab")
        left = at.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        at = store(left, "edges", owner)
    mixed = len(rounds) > PLAIN_ROUNDS
    rounds.append(at.coalesce(1).mapInArrow(_joined, "u long, l long"))
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("u").alias("l"), F.col("l").alias("to")), "l", "left").select("u", F.coalesce("to", "l").alias("l"))
    if mixed:
        out = store(out, "labels", owner)
        out = out.join(out.groupBy("l").agg(F.min("u").alias("least")), "l").select("u", F.col("least").alias("l"))
    return store(out.select(F.col("u").alias("id"), F.col("l").alias("component")), "components", owner)


def size_step(sizes: np.ndarray) -> np.ndarray:
    return np.minimum((1 << SIZE_BITS) - 1, np.floor(np.log(np.maximum(sizes, 1)) / np.log(SIZE_STEP))).astype(np.uint64)


def packed_keys(hashes: np.ndarray, sizes: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """Keys whose high bits are a hash and whose low bits hold the place (0 to 63) and the size step."""
    low = size_step(sizes) | (0 if places is None else places.astype(np.uint64) << np.uint64(SIZE_BITS))
    return ((hashes & ~np.uint64((1 << LOW_BITS) - 1)) | low).view(np.int64)


@dataclass(frozen=True)
class Reach:
    """How far two owners of one key may differ: steps of size, and places."""

    steps: int
    places: int

    @classmethod
    def of(cls, size_ratio: float, places: int = 0) -> Reach:
        return cls(int(np.ceil(-np.log(size_ratio) / np.log(SIZE_STEP))) + 1, places)

    def test(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size, place = (1 << SIZE_BITS) - 1, (1 << PLACE_BITS) - 1
        return (np.abs((x & size) - (y & size)) <= self.steps) & (np.abs((x >> SIZE_BITS & place) - (y >> SIZE_BITS & place)) <= self.places)

    def cells(self, entries: DataFrame) -> DataFrame:
        """(key, id) with every bucket cut into cells of twice the reach, in grids shifted by it, so that any two within reach share a cell."""
        grids = []
        for value, reach in ((F.col("key").bitwiseAND((1 << SIZE_BITS) - 1), self.steps), (F.shiftright("key", SIZE_BITS).bitwiseAND((1 << PLACE_BITS) - 1), self.places)):
            shifts = [F.struct(F.lit(g).alias("g"), F.floor((value + g * reach) / (2 * reach)).cast("long").alias("c")) for g in (0, 1)] if reach else [F.struct(F.lit(0).alias("g"), value.cast("long").alias("c"))]
            grids.append(F.array(*shifts))
        low = F.lit((1 << LOW_BITS) - 1).cast("long")
        cut = entries.withColumn("s", F.explode(grids[0])).withColumn("p", F.explode(grids[1]))
        key = F.xxhash64(F.shiftright("key", LOW_BITS), "s", "p").bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("key").bitwiseAND(low))
        return cut.select(key.alias("key"), "id")


def _found(pairs, crowds=(), sketched: bool = False) -> pa.RecordBatch:
    """Rows (a, b) of pairs, and rows (key, b) of members of crowded buckets with up to two others to meet in ``a`` and ``c``, and the members' sketches."""
    join = lambda arrays: np.concatenate([np.empty(0, np.int64), *arrays])
    a, b = (join([p[j] for p in pairs]) for j in (0, 1))
    key, b2, a2, c2, sketch = (join([c[j] for c in crowds]) for j in range(5))
    none = np.arange(len(a) + len(key)) < len(a)
    alone = lambda other: np.concatenate([np.zeros(len(a), bool), other == b2])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.minimum(a, b), a2]), mask=alone(a2)), pa.array(np.concatenate([np.maximum(a, b), b2])),
            pa.array(np.concatenate([a, key]), mask=none), pa.array(np.concatenate([a, c2]), mask=none | alone(c2)),
            *([pa.array(np.concatenate([a, sketch]), mask=none)] if sketched else []),
        ],
        ["a", "b", "key", "c"] + ["sketch"] * sketched,
    )


def _scan(reach: Reach, small: int, alike=None):
    """Candidate pairs of sorted (key, id) rows, and the members of larger buckets; never holds more of a bucket than one batch and ``PART``.

    A member of such a bucket is to meet the first and the one before it, if
    within reach. With ``alike`` rows bring sketches too, and only pairs that
    it admits count. Then buckets of up to ``PART`` members lose those that
    are alike with none, and are not crowded if they have few such pairs.
    """
    most = small if alike is None else max(small, PART)
    meet = reach.test if alike is None else lambda x, y, u, v: reach.test(x, y) & alike(x, y, u, v)

    def whole(k, i, s):
        """Of complete buckets."""
        b = k >> LOW_BITS
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        n = np.diff(np.concatenate((starts, [len(k)])))
        pairs, crowds = [], []
        for size in np.unique(n[n > 1]):
            own = starts[n == size]
            if size <= small:
                x, y = np.triu_indices(size, 1)
                x, y = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
                near = test(k, s, x, y)
                pairs.append((i[x[near]], i[y[near]]))
            else:
                for at in own:
                    row = slice(at, at + size)
                    if size > most or alike is None:
                        crowd(k[row], i[row], s[row], None, crowds)
                    else:
                        thinned(k[row], i[row], s[row], pairs, crowds)
        return _found(pairs, crowds, alike is not None)

    def test(k, s, x, y):
        return meet(k[x], k[y]) if alike is None else np.concatenate([np.empty(0, bool), *(meet(k[x[a : a + PAIRS]], k[y[a : a + PAIRS]], s[x[a : a + PAIRS]], s[y[a : a + PAIRS]]) for a in range(0, len(x), PAIRS))])

    def thinned(k, i, s, pairs, crowds):
        """Of a larger bucket whose members are held against each other: its pairs, if no more than those of small ones, or its members with the first and the last alike before each."""
        n = len(k)
        first, last, met, found, count = np.full(n, -1), np.full(n, -1), np.zeros(n, bool), [], 0
        step = max(1, PAIRS // n)
        for low in range(0, n, step):
            high = min(n, low + step)
            x, y = np.nonzero(reach.test(k[low:high, None], k) & (np.arange(low, high)[:, None] < np.arange(n)))
            x += low
            ok = alike(k[x], k[y], s[x], s[y])
            x, y = x[ok], y[ok]
            met[x] = met[y] = True
            last[y] = np.maximum(last[y], x)  # the rows of x rise, so that the last one written is the largest
            first[y[::-1]] = np.where(first[y[::-1]] < 0, x[::-1], first[y[::-1]])
            count += len(x)
            if 2 * count <= small * n:
                found.append((i[x], i[y]))
        if 2 * count <= small * int(met.sum()):
            pairs += found
            return
        lead, prev = np.where(first < 0, i, i[first]), np.where(last < 0, i, i[last])
        crowds.append((k[met], i[met], lead[met], np.where(prev == lead, i, prev)[met], s[met]))

    def crowd(k, i, s, before, crowds):
        """Of (a part of) a crowded bucket; returns its first and its last member, for the next part."""
        first, last = before or ((k[0], i[0], s[0]), (k[0], i[0], s[0]))
        x, y, z = (np.concatenate((v[None], w[:-1])) for v, w in zip(last, (k, i, s), strict=True))
        near = [meet(u, k, *((v, s) if alike is not None else ())) for u, v in ((np.full(len(k), first[0]), np.full(len(k), first[2])), (x, z))]
        lead = np.where(near[0], first[1], i)
        crowds.append((k, i, lead, np.where(near[1] & (y != lead), y, i), s))
        return first, (k[-1], i[-1], s[-1])

    def run(batches):
        none = np.empty(0, np.int64)
        k, i, s, before = none, none, none, None
        for batch in batches:
            k, i, s = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((k, "key"), (i, "id"), (s, "id" if alike is None else "sketch")))
            if not len(k):
                continue
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])))  # a line may come from several documents
            k, i, s = k[new], i[new], s[new]
            b, crowds = k >> LOW_BITS, []
            if before is not None:
                own = int(np.searchsorted(b, before[0][0] >> LOW_BITS, side="right"))
                before = crowd(k[:own], i[:own], s[:own], before, crowds) if own else None
                k, i, s, b = k[own:], i[own:], s[own:], b[own:]
                if not len(k):
                    yield _found([], crowds, alike is not None)
                    continue
                before = None
            hold = int(np.searchsorted(b, b[-1]))
            if hold:
                yield whole(k[:hold], i[:hold], s[:hold])
            k, i, s = k[hold:], i[hold:], s[hold:]
            if len(k) > most:
                before = crowd(k, i, s, None, crowds)
                k, i, s = none, none, none
            if crowds:
                yield _found([], crowds, alike is not None)
        if len(k) > 1:
            yield whole(k, i, s)

    return run


def _ordered(k: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The order of distinct rows by key, then id."""
    order = np.argsort(k)
    same = k[order[1:]] == k[order[:-1]]
    tied = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    if len(tied):
        rows = order[tied]
        order[tied] = rows[np.lexsort((i[rows], k[rows]))]
        order = order[np.concatenate(([True], ~same | (i[order[1:]] != i[order[:-1]])))]
    return order


def _packed(entries):
    """Rows (range, rows): the distinct rows (key, id, sketch) that ``entries`` makes of batches, ``PACK`` at a time, by ranges of keys.

    Spark's own rows would be half as large again, and cost more to sort than all else that is done with them.
    """

    def pack(held):
        k, i, s = (np.concatenate([h[j] for h in held]) for j in range(3))
        held.clear()
        order = _ordered(k, i)
        rows = np.empty((len(order), 3), np.int64)
        for j, column in enumerate((k, i, s)):
            rows[:, j] = column[order]
        ranges = rows[:, 0] >> (64 - RANGE_BITS)
        starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
        ends = (np.append(starts, len(rows)) * rows.itemsize * 3).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(ranges[starts].astype(np.int32)), packed], ["range", "rows"])

    def run(batches):
        held, n = [], 0
        for part in entries(batches):
            held.append([part.column(c).to_numpy() for c in ("key", "id", "sketch")])
            n += len(part)
            if n >= PACK:
                yield pack(held)
                n = 0
        if n:
            yield pack(held)

    return run


def _unpacked(batches):
    """Batches (key, id, sketch), sorted by key and id, of rows (range, rows) sorted by range; holds the entries of one range."""

    def whole(held):
        rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, 3)
        rows = rows[_ordered(rows[:, 0], rows[:, 1])]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["key", "id", "sketch"])

    last, held = None, []
    for batch in batches:
        for r, rows in zip(batch.column("range").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if r != last and held:
                yield whole(held)
                held = []
            last = r
            held.append(rows)
    if held:
        yield whole(held)


def buckets(entries: DataFrame, reach: Reach, small: int, owner: str = "") -> tuple[DataFrame, DataFrame]:
    """Stored candidate pairs (a, b, n), a < b, found ``n`` times, and members (key, id) of buckets that are still crowded.

    ``entries``: (key, id) with :func:`packed_keys`. One shuffle deals them by
    the high bits of their keys; within a task they are sorted, which can
    spill, and streamed. All pairs within reach of buckets of up to ``small``
    members are candidates; where places count, larger ones are cut into cells.
    """

    def scan(e):
        dealt = e.repartition(F.shiftright("key", LOW_BITS)).sortWithinPartitions("key", "id")
        out = store(dealt.mapInArrow(_scan(reach, small), "a long, b long, key long, c long"), "buckets", owner)
        free_shuffles(e.sparkSession)
        return out

    tables = [scan(entries)]
    if reach.places:
        tables.append(scan(reach.cells(tables[0].where("key is not null").select("key", F.col("b").alias("id")))))
    crowded = tables[-1].where("key is not null")
    pairs = crowded.select(F.least("c", "b"), F.greatest("c", "b")).where("c is not null").union(crowded.select(F.least("a", "b"), F.greatest("a", "b")).where("a is not null")).toDF("a", "b")
    for t in tables:
        pairs = pairs.union(t.where("key is null").select("a", "b"))
    pairs = store(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs", owner)
    return pairs, crowded.select(F.shiftright("key", LOW_BITS).alias("key"), F.col("b").alias("id"))


def whole_buckets(rows: DataFrame, entries, reach: Reach, small: int, owner: str, alike) -> tuple[DataFrame, DataFrame]:
    """Like :func:`buckets`, but crowded ones are not cut into cells: (key, id, sketch) with the whole key, for :func:`connect_texts`.

    ``entries``: makes batches (key, id, sketch) of those of ``rows``.
    ``alike(x, y, u, v)``: whether pairs of keys x, y with sketches u, v may be linked.
    A task holds the entries of one of ``2 ** RANGE_BITS`` ranges of keys.
    """
    packed = rows.mapInArrow(_packed(entries), "range int, rows binary")
    scan = _scan(reach, small, alike)
    dealt = packed.repartition("range").sortWithinPartitions("range")
    out = store(dealt.mapInArrow(lambda batches: scan(_unpacked(batches)), "a long, b long, key long, c long, sketch long"), "buckets", f"{owner}-buckets")
    free_shuffles(rows.sparkSession)
    some = out.where("key is not null")
    pairs = out.where("key is null").select("a", "b")
    for other in ("a", "c"):
        pairs = pairs.union(some.where(F.col(other).isNotNull()).select(F.least(other, "b").alias("a"), F.greatest(other, "b").alias("b")))
    pairs = store(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs", owner)
    crowded = store(some.select("key", F.col("b").alias("id"), "sketch").distinct(), "crowded", owner)
    release(rows.sparkSession, f"{owner}-buckets")
    free_shuffles(rows.sparkSession)
    return pairs, crowded


def connect_texts(
    pairs: DataFrame,
    crowded: DataFrame,
    texts: DataFrame,
    reach: Reach,
    sign: Callable[[list[str]], np.ndarray],
    near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    linked: Callable[[list[str], list[str]], np.ndarray],
    alike: Callable[..., np.ndarray],
    owner: str = "",
) -> DataFrame:
    """Stored (id, component) of all that links connect; ids without a link are left out.

    ``pairs`` and ``crowded``: what :func:`whole_buckets` gives. ``texts`` (id,
    norm). ``sign`` makes signatures of texts, of which ``near`` is as in
    :func:`connect`; ``linked``: whether each of some texts and the other of
    its pair are; ``alike``: as in :func:`whole_buckets`.

    First each id meets the one that it shares most buckets with, then the
    pairs of small buckets that would join two components are compared. Members
    of crowded buckets that still have several components come together by
    their keys and sketches; those that are alike with none of another
    component for which the bucket is the first that both share go. The others
    come together with their texts once: each pair within reach that could
    join two is compared in the first such bucket that it shares, unless links
    of the bucket have joined the two by then. No pair is left out. This is
    quadratic in a large bucket's members, in one task up to ``PART`` of them.
    """
    spark = pairs.sparkSession

    def verify(candidates: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("id").alias(k), F.col("norm").alias(n)) for k, n in ("ax", "by"))
        return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_compared(linked), "a long, b long")

    def joined(known: DataFrame, links: DataFrame) -> DataFrame:
        links = store(links, "links", owner)
        free_shuffles(spark)
        if links.isEmpty():
            return known
        return components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), owner)

    first = store(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "first-pairs", owner)
    known = components(store(verify(first), "links", owner), owner)
    free_shuffles(spark)
    a, b = (known.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    apart = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    known = joined(known, verify(apart.join(first, ["a", "b"], "left_anti")))
    if crowded.isEmpty():
        return known
    bucket = F.shiftright("key", LOW_BITS).alias("bucket")
    marked = store(crowded.join(known, "id", "left").select("id", "key", "sketch", bucket, F.coalesce("component", "id").alias("c")), "marked", owner)
    mixed = marked.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 <> c1")
    own = marked.join(mixed.select("bucket", "n"), "bucket").groupBy("id", "c", "sketch").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    met = store(_dealt(own, "sketch").mapInArrow(_crowds(reach, _by_sketches(alike)), "id long, c long, key long"), "met", owner).distinct()
    met = store(met.withColumn("bucket", bucket), "met", owner)
    free_shuffles(spark)
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    own = met.join(sizes, "bucket").groupBy("id", "c").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    signed = store(own.join(texts, "id").select("id", "c", "keys", "norm").mapInArrow(_signed(sign), "id long, c long, keys array<struct<key:long,n:long>>, norm string, sig binary"), "signed", owner)
    free_shuffles(spark)
    links = []
    for k in range(SLICES):
        links.append(store(_dealt(signed, "norm", "sig", part=k).mapInArrow(_crowds(reach, near, linked), "a long, b long"), "links", owner))
        free_shuffles(spark)
    return joined(known, reduce(DataFrame.union, links))


def _dealt(own: DataFrame, *others: str, part: int | None = None) -> DataFrame:
    """Rows (id, c, keys, ...) once for each key and part of its bucket to meet, one bucket, or pair of its parts, after the other; with ``part``, of one of ``SLICES``."""
    each = own.select("id", "c", F.col("keys.key").alias("keys"), *others, F.explode("keys").alias("k"))
    bucket = F.shiftright("k.key", LOW_BITS).alias("bucket")
    if part is not None:
        each = each.where(F.pmod(bucket, F.lit(SLICES)) == part)
    each = each.select("id", "c", "keys", *others, "k.key", bucket, F.ceil(F.col("k.n") / F.lit(PART)).cast("int").alias("parts"))
    each = each.select("id", "c", "keys", *others, "key", "bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    each = each.select("id", "c", "keys", *others, "key", "bucket", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return each.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")


def _by_sketches(alike):
    """``alike`` on rows of bytes of keys and sketches."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (k, u), (l, v) = (np.ascontiguousarray(z).view(np.int64).T for z in (x, y))  # noqa: E741
        return np.where(alike(k, l, u, v), 0, -1)

    return near


def _compared(linked):
    def run(batches):
        for batch in batches:
            ok = linked(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _signed(sign):
    def run(batches):
        for batch in batches:
            sigs = [x.tobytes() for x in sign(batch.column("norm").to_pylist())] if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.binary())], ["id", "c", "keys", "norm", "sig"])

    return run


def _crowds(reach: Reach, near, linked=None):
    """Links (a, b) between components of buckets whose sorted rows come one bucket, or pair of its parts, after the other.

    Without ``linked``, the rows (id, c, key) that ``near`` admits, by keys and sketches, with one of another component.
    """
    group = ["bucket", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        row = lambda batch, k: [batch.column(c)[k] for c in group]
        for batch in batches:
            if len(batch):
                held.append(batch)
                if row(held[0], 0) != row(batch, len(batch) - 1):
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    starts = begins(t)
                    yield from found(t.slice(0, starts[-1]))
                    held = [t.slice(starts[-1])]
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def begins(t):
        new = np.zeros(len(t), bool)
        new[0] = True
        for c in group:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def found(t):
        ids, c, key, bucket, part, i, j = (t.column(x).to_numpy() for x in ("id", "c", "key", "bucket", "part", "i", "j"))
        texts, lists, a, b = t.column("norm") if linked else None, t.column("keys"), [], []
        met, sketch = np.zeros(len(t), bool), None if linked else np.stack([key, t.column("sketch").to_numpy()], axis=1).view(np.uint8)
        starts = begins(t)
        label, held, n = c.copy(), [], 0  # of the components, as links of a bucket join them there; pairs that are to be compared
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(t)]))
        for at, end in zip(starts, [*starts[1:], len(t)], strict=True):
            own = slice(at, end)
            sigs = np.frombuffer(b"".join(t.column("sig").slice(at, end - at).to_pylist()), np.uint8).reshape(end - at, -1) if linked else sketch[own]
            keys = None
            for p, q, score in candidates(label[own], key[own], part[own], sigs, i[at] != j[at]):
                keys = matrix(lists.slice(at, end - at)) if keys is None else keys
                mine = first_shared(keys, p, q, bucket[at])
                p, q, score = p[mine], q[mine], score[mine]
                if linked is None:
                    met[p + at] = met[q + at] = True
                    continue
                order = np.lexsort((ids[q + at], ids[p + at], -score))
                held.append((p[order] + at, q[order] + at))
                n += len(order)
                if n >= PAIRS:
                    compare(held, label, of, starts, texts, ids, a, b)
                    n = 0
        if held:
            compare(held, label, of, starts, texts, ids, a, b)
        if linked is None:
            yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (ids, c, key)], ["id", "c", "key"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(held, label, of, starts, texts, ids, a, b):
        """Add the links among pairs of rows; of each row's pairs the best go first, then four times as many of those still apart."""
        p, q = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        held.clear()
        rows, at = np.unique(np.concatenate((p, q)), return_inverse=True)
        text, most = texts.take(pa.array(rows)).to_pylist(), 1
        x, y = at[: len(p)], at[len(p) :]
        while True:
            apart = label[p] != label[q]
            p, q, x, y = p[apart], q[apart], x[apart], y[apart]
            if not len(p):
                return
            order = np.argsort(p, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], p[order[1:]] != p[order[:-1]])))
            rank = np.empty(len(p), np.int64)
            rank[order] = np.arange(len(p)) - np.repeat(first, np.diff([*first, len(p)]))
            now = np.flatnonzero(rank < most)
            for k in now[linked([text[z] for z in x[now].tolist()], [text[z] for z in y[now].tolist()])].tolist():
                u, v = label[p[k]], label[q[k]]
                if u != v:
                    own = slice(starts[of[p[k]]], starts[of[p[k]] + 1] if of[p[k]] + 1 < len(starts) else None)
                    label[own][label[own] == max(u, v)] = min(u, v)
                    a.append(min(ids[p[k]], ids[q[k]]))
                    b.append(max(ids[p[k]], ids[q[k]]))
            later = rank >= most
            p, q, x, y = p[later], q[later], x[later], y[later]
            most *= 4

    def candidates(label, key, part, sigs, parts):
        """A few at a time, pairs of a group's rows of two components that may be linked, with their scores; with ``parts``, of two different ones."""
        values, sizes = np.unique(label, return_counts=True)
        if len(values) < 2:
            return
        out = label != values[np.argmax(sizes)]
        order = np.concatenate([np.flatnonzero(out), np.flatnonzero(~out)])  # of a pair, one at least is outside the main component
        step = max(1, PAIRS // len(order))
        for low in range(0, int(out.sum()), step):
            x = order[low : min(int(out.sum()), low + step)]
            y = order[low:]
            ok = (label[x][:, None] != label[y]) & reach.test(key[x][:, None], key[y]) & (np.arange(len(x))[:, None] < np.arange(len(y)))
            if parts:
                ok &= part[x][:, None] != part[y]
            p, q = np.nonzero(ok)
            p, q = x[p], y[q]
            score = near(sigs[p], sigs[q])
            if (score >= 0).any():
                yield p[score >= 0], q[score >= 0], score[score >= 0]

    def matrix(lists):
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        out = np.full((len(sizes), sizes.max()), np.iinfo(np.int64).max)
        out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        return out

    def first_shared(keys, p, q, bucket):
        """Whether no bucket before ``bucket`` has the pair within reach, with no more than ``CELLS`` pairs of keys in memory."""
        out, step = np.zeros(len(p), bool), max(1, CELLS // keys.shape[1] ** 2)
        for k in range(0, len(p), step):
            x, y = keys[p[k : k + step]][:, :, None], keys[q[k : k + step]][:, None, :]
            out[k : k + step] = ~((x >> LOW_BITS == y >> LOW_BITS) & (x >> LOW_BITS < bucket) & reach.test(x, y)).any(axis=(1, 2))
        return out

    return run


def connect(
    pairs: DataFrame,
    crowded: DataFrame,
    signatures: DataFrame,
    near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    verify: Callable[[DataFrame], DataFrame],
    owner: str = "",
    narrower: Callable[[DataFrame], DataFrame] | None = None,
    fits: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """Stored (id, component) of all that links connect; ids without a link are left out.

    ``pairs`` and ``crowded``: what :func:`buckets` gives. ``signatures`` (id,
    sig): bytes of equal length. ``near(x, y)``: for two arrays of signatures
    (last axis: bytes; the others broadcast), a score for each pair, negative
    where the pair can't be linked. ``verify(pairs)``: the truly linked ones of
    candidate pairs (a, b).

    First each id meets the one that it shares most buckets with, which makes
    few components of groups of copies from as many pairs as members. Then only
    pairs that would join two components are held against each other. Of a
    crowded bucket that still has several, the members outside its largest
    component meet the whole bucket in blocks of ``CHUNK`` by ``CHUNK``
    signatures; each offers its best candidate in another component. Those
    that held some back meet the bucket again and offer eight times as many,
    until none was held back: no pair that could join two components is left
    out, as components only grow, and pairs within one are never made.

    ``narrower(ids)`` gives other buckets (key, id, rest, ...) for the members
    of those that have several components: any two that can be linked must
    share one in which ``fits(x, y)`` holds, for rows x and columns y of a
    block. ``rest`` falls along one order of all keys, and ``fits`` holds in
    the first that two share if in any. So members that have a bucket's usual
    ``before``, their own key before it in that order, in common have met there.
    """
    first = store(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "first-pairs", owner)
    known = components(verify(screened(first, signatures, near)), owner)
    a, b = (known.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    apart = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    untested, best = apart.join(first, ["a", "b"], "left_anti"), 1
    crowded = store(crowded.distinct(), "crowded", owner)
    if narrower is not None and not crowded.isEmpty():
        marked = crowded.join(known, "id", "left").withColumn("c", F.coalesce("component", "id"))
        mixed = marked.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
        ids = store(crowded.join(mixed.select("key"), "key", "left_semi").select("id").distinct(), "mixed", owner)
        earlier = F.lag("key").over(Window.partitionBy("id").orderBy(F.desc("rest")))
        crowded = store(narrower(ids).withColumn("before", earlier), "crowded", owner)
    held = None
    while True:
        offered = _offers(crowded, known, signatures, near, best, owner, fits, held)
        held = None if offered is None else store(offered.where("held is not null").select("key", F.col("held").alias("id")).distinct(), "held", owner)
        more = held is not None and not held.isEmpty()
        if offered is not None:
            offered = offered.select("a", "b")
            untested = offered if untested is None else untested.union(offered)
        if untested is not None:
            links = store(verify(screened(untested.distinct(), signatures, near)), "links", owner)
            if not links.isEmpty():
                known = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), owner)
        if not more:
            return known
        untested, best = None, best * 8


def _offers(crowded: DataFrame, known: DataFrame, signatures: DataFrame, near, best: int, owner: str, fits=None, held: DataFrame | None = None) -> DataFrame | None:
    """Stored (a, b, key, held): candidates that would join two components of a crowded bucket, and the id that held others back; none if each bucket has one.

    The members outside the main component offer, or those without the usual
    key before the bucket's if they are fewer, or those of ``held`` (key, id).
    """
    if crowded.isEmpty():
        return None
    marked = crowded.join(known, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    sizes = marked.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("main"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
    if held is None:
        if "before" in marked.columns:
            usual = marked.where("before is not null").groupBy("key", "before").agg(F.count(F.lit(1)).alias("m"))
            usual = usual.groupBy("key").agg(F.max_by("before", F.struct("m", "before")).alias("usual"), F.max("m").alias("met"))
            main = main.join(usual, "key", "left").withColumn("few", F.coalesce(F.col("n") - F.col("met") < F.col("outside"), F.lit(False)))
            main = main.withColumn("outside", F.when(F.col("few"), F.col("n") - F.col("met")).otherwise(F.col("outside"))).where("outside > 0")
            out = F.when(F.col("few"), ~F.col("before").eqNullSafe(F.col("usual"))).otherwise(F.col("c") != F.col("main"))
            marked = marked.join(main, "key").withColumn("out", out).drop("before", "usual", "met", "few")
        else:
            marked = marked.join(main, "key").withColumn("out", F.col("c") != F.col("main"))
    else:
        some = main.select("key", "main", "n").join(held.groupBy("key").agg(F.count(F.lit(1)).alias("outside")), "key")
        marked = marked.drop("before").join(some, "key").join(held.withColumn("out", F.lit(True)), ["key", "id"], "left").withColumn("out", F.coalesce("out", F.lit(False)))
    marked = store(marked, "marked", owner)
    if marked.isEmpty():
        return None
    return store(_blocks(marked).join(signatures, "id").groupBy("key", "i", "j").applyInPandas(_offer(near, best, fits), "a long, b long, key long, held long"), "offers", owner)


def _blocks(marked: DataFrame) -> DataFrame:
    """Deal every bucket's members outside its main component (x), and all its members (y), to blocks."""
    nx, ny = F.ceil(F.col("outside") / F.lit(CHUNK)).cast("int"), F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    i, j = F.pmod(F.xxhash64("id"), nx).cast("int"), F.pmod(F.xxhash64("id"), ny).cast("int")
    own = [c for c in marked.columns if c not in ("main", "n", "outside", "out")]
    x = marked.where("out").select(*own, F.lit(True).alias("x"), i.alias("i"), F.explode(F.sequence(F.lit(0), ny - 1)).alias("j"))
    y = marked.select(*own, F.lit(False).alias("x"), F.explode(F.sequence(F.lit(0), nx - 1)).alias("i"), j.alias("j"))
    return x.union(y)


def _offer(near, best: int, fits=None):
    def offer(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["x"]], group[~group["x"]]
        empty = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "key": np.empty(0, np.int64), "held": pd.array([], "Int64")})
        if not len(x) or not len(y):
            return empty
        rows = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        apart = x["c"].to_numpy()[:, None] != y["c"].to_numpy()[None, :]
        if fits is None:
            score = near(rows(x["sig"])[:, None], rows(y["sig"])[None])
            p, q = np.nonzero(apart & (score >= 0))
            score = score[p, q]
        else:
            p, q = np.nonzero(apart & fits(x, y))
            sx, sy = rows(x["sig"]), rows(y["sig"])
            score = np.concatenate([np.empty(0, np.int32), *(near(sx[p[k : k + PAIRS]], sy[q[k : k + PAIRS]]) for k in range(0, len(p), PAIRS))])
            p, q, score = p[score >= 0], q[score >= 0], score[score >= 0]
        if not len(p):
            return empty
        a, b = x["id"].to_numpy()[p], y["id"].to_numpy()[q]
        found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "x": p, "s": score})
        found = found.sort_values(["s", "a", "b"], ascending=[False, True, True])
        kept = found.groupby("x", sort=False).head(best)
        held = pd.Series(x["id"].to_numpy()[kept["x"]], kept.index, "Int64").where(np.bincount(p, minlength=len(x))[kept["x"]] > best)
        return kept[["a", "b"]].assign(key=group["key"].iloc[0], held=held)

    return offer


def screened(pairs: DataFrame, signatures: DataFrame, near) -> DataFrame:
    """The candidate pairs (a, b) that ``near`` doesn't rule out."""

    def screen(batches):
        for t in batches:
            if len(t):
                rows = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
                yield t.loc[near(rows(t["x"]), rows(t["y"])) >= 0, ["a", "b"]]

    both = pairs.join(signatures.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b").join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInPandas(screen, "a long, b long")
