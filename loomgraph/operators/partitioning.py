"""Placement of hyperedges and vertices, and its quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import root_of_squares
from ..graph import Hypergraph, dense_rank_by


@dataclass(frozen=True)
class Costs:
    degree: float = 5.0
    replica: float = 10.0
    demand: float = 1.0


def random_vertices(g: Hypergraph, k: int, seed: int = 1) -> DataFrame:
    return g.vertices.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int").alias("pid"))


def plain(g: Hypergraph, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Hyperedges (hid, pid) round robin in the order of hid, vertices (id, pid) by hash."""
    dealt = dense_rank_by(g.hyperedges.select("hid"), "hid", "n").select("hid", F.pmod("n", F.lit(k)).cast("int").alias("pid"))
    return dealt, random_vertices(g, k, seed)


def bipartite(g: Hypergraph, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    return g.hyperedges.select("hid", F.pmod(F.xxhash64("hid", F.lit(seed + 1)), F.lit(k)).cast("int").alias("pid")), random_vertices(g, k, seed)


def _shards(g: Hypergraph, shards: int) -> DataFrame:
    return g.hyperedges.select("hid", "src", "dst").repartition(shards, "hid").sortWithinPartitions("hid")


def aweto(g: Hypergraph, k: int, shards: int = 8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """In every shard each hyperedge goes to the part with the least degree so far; a task keeps ``k`` numbers."""

    def place(frames):
        load = np.zeros(k, np.int64)
        for t in frames:
            pids = []
            for s, d in zip(t["src"], t["dst"], strict=True):
                p = int(np.argmin(load))
                load[p] += len(s) + len(d)
                pids.append(p)
            yield pd.DataFrame({"hid": t["hid"], "pid": np.array(pids, np.int32)})

    return _shards(g, shards).mapInPandas(place, "hid long, pid int"), random_vertices(g, k, seed)


def greedy(g: Hypergraph, k: int, shards: int = 8, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """Two passes in every shard: place each hyperedge where new demand and degree cost least, then try again with all placed.

    Vertices then go where they are demanded and few are. A task keeps the
    members of its shard and their demand in flat arrays, 4 bytes a member and
    4 k a vertex.
    """

    def place(frames):
        hids, sizes, weights, members = [], [], [], []
        ids = np.empty(0, np.int64)
        for t in frames:
            if not len(t):
                continue
            lengths = [np.fromiter(map(len, t[c]), np.int64, len(t)) for c in ("src", "dst")]
            n = lengths[0] + lengths[1]
            row = np.concatenate([np.repeat(np.arange(len(t)), x) for x in lengths])
            flat = np.concatenate([np.concatenate(t[c].to_numpy()) for c in ("src", "dst")]).astype(np.int64)
            order = np.lexsort((flat, row))
            row, flat = row[order], flat[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])
            hids.append(t["hid"].to_numpy(np.int64, copy=True))
            sizes.append(np.bincount(row[first], minlength=len(t)).astype(np.int32))
            weights.append(n.astype(np.int32))
            members.append(flat[first])
            ids = np.union1d(ids, members[-1]) if len(members) % 32 == 0 else ids
        if not hids:
            return
        ids = np.unique(np.concatenate([ids, *(np.unique(m) for m in members)]))
        for i, m in enumerate(members):  # each gives its memory back
            members[i] = np.searchsorted(ids, m).astype(np.int32)
        demand = np.zeros((len(ids), k), np.int32)
        degree = np.zeros(k)
        pids = [np.empty(len(h), np.int32) for h in hids]
        for again in (False, True):
            for size, weight, member, pid in zip(sizes, weights, members, pids, strict=True):
                end = 0
                for i, (m, n) in enumerate(zip(size.tolist(), weight.tolist(), strict=True)):
                    own = member[end : (end := end + m)]
                    if again:
                        degree[pid[i]] -= n
                        demand[own, pid[i]] -= 1
                    new = (demand[own] == 0).sum(axis=0)
                    pid[i] = p = int(np.argmin(new * costs.demand + degree * costs.degree))
                    degree[p] += n
                    demand[own, p] += 1
        for h, pid in zip(hids, pids, strict=True):
            yield pd.DataFrame({"hid": h, "pid": pid})

    placed = _shards(g, shards).mapInPandas(place, "hid long, pid int")
    needs = g.incidence.join(placed, "hid").select(F.col("vid").alias("id"), "pid").distinct()
    load = needs.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))  # k rows
    least = needs.join(F.broadcast(load), "pid").groupBy("id").agg(F.min_by("pid", F.struct("n", "pid")).alias("p"))
    return placed, g.vertices.select("id").join(least, "id", "left").select("id", F.coalesce("p", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")).alias("pid"))


def replica(g: Hypergraph, k: int, costs: Costs = Costs(), seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """One stream of all hyperedges, each to the part with most overlap for its degree. By nature one task."""

    def place(frames):
        have: dict[int, int] = {}  # the parts that have a vertex, as bits
        degree = [0.0] * k
        parts = range(k)
        for t in frames:
            pids = []
            for s, d in zip(t["src"], t["dst"], strict=True):
                s, d = s.tolist(), d.tolist()
                members = {*s, *d}
                held = [b for v in members if (b := have.get(v, 0))]
                worth = [sum([b >> i & 1 for b in held]) * costs.replica - degree[i] * costs.degree for i in parts] if held else [-x * costs.degree for x in degree]
                p = worth.index(max(worth))
                for v in members:
                    have[v] = have.get(v, 0) | 1 << p
                degree[p] += len(s) + len(d)
                pids.append(p)
            yield pd.DataFrame({"hid": t["hid"], "pid": np.array(pids, np.int32)})

    return g.hyperedges.select("hid", "src", "dst").repartition(1).sortWithinPartitions("hid").mapInPandas(place, "hid long, pid int"), random_vertices(g, k, seed)


def explicit(g: Hypergraph, vertices: DataFrame, hyperedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placements given as (hid, pid) and (id, pid), of this hypergraph's members only."""
    return hyperedges.join(g.hyperedges.select("hid"), "hid", "left_semi"), vertices.join(g.vertices.select("id"), "id", "left_semi")


def partition_by(g: Hypergraph, k: int, hyperedges: DataFrame, vertices: DataFrame) -> Hypergraph:
    """The hypergraph laid out in ``k`` partitions by the placements."""
    h = g.hyperedges.join(hyperedges, "hid").repartition(k, "pid").drop("pid")
    return Hypergraph(g.vertices.join(vertices, "id").repartition(k, "pid").drop("pid"), h)


def per_partition(g: Hypergraph, k: int, hyperedges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pid, n_hyperedges, demand, local, replicas, src_degree, dst_degree) for every part; zeros where it is empty."""
    edges = g.hyperedges.join(hyperedges, "hid")
    sums = edges.groupBy("pid").agg(F.count(F.lit(1)).alias("n_hyperedges"), F.sum(F.size("src")).alias("src_degree"), F.sum(F.size("dst")).alias("dst_degree"))
    needs = edges.select("pid", F.explode(F.array_union("src", "dst")).alias("id")).distinct()
    own = vertices.select("id", "pid", F.lit(1).alias("here"))
    needed = needs.join(own, ["id", "pid"], "left").groupBy("pid").agg(F.count(F.lit(1)).alias("demand"), F.sum(F.when(F.col("here").isNull(), 1).otherwise(0)).alias("replicas"))
    local = vertices.groupBy("pid").agg(F.count(F.lit(1)).alias("local"))
    pids = g.vertices.sparkSession.range(k).select(F.col("id").cast("int").alias("pid"))
    out = pids.join(sums, "pid", "left").join(needed, "pid", "left").join(local, "pid", "left")
    return out.select("pid", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hyperedges", "demand", "local", "replicas", "src_degree", "dst_degree")))


def statistics(g: Hypergraph, k: int, hyperedges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(measure, mean, least, most, spread, std) over parts; spread: root of the summed squares, not divided by the count."""
    parts = per_partition(g, k, hyperedges, vertices)
    names = parts.columns[1:]
    long = parts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("x")) for n in names))))
    return long.groupBy("measure").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), root_of_squares(F.col("x")).alias("spread"), F.stddev_pop("x").alias("std"))


def replica_factor(g: Hypergraph, k: int, hyperedges: DataFrame, vertices: DataFrame) -> float:
    total = per_partition(g, k, hyperedges, vertices).agg(F.sum("replicas")).first()[0] or 0
    return total / max(1, g.num_vertices())
