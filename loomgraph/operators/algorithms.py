"""Random walk, label propagation, betweenness and spectral embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Hypergraph
from ..plans.lineage import Rounds
from ..schema import Direction
from .degrees import incidents
from .pregel import pregel


def least_mode(c: Column) -> Column:
    """The most frequent value, the least of several."""
    return F.mode(c, deterministic=True)


def random_walk(g: Hypergraph, starts: DataFrame, iterations: int = 10, reset: float = 0.15) -> DataFrame:
    """(id, score) of a walk with restart at ``starts`` (id)."""
    rounds = Rounds(g.vertices.sparkSession)
    g = Hypergraph(g.vertices, rounds.cut(g.hyperedges, "hid"))
    state = g.vertices.select("id").join(incidents(g, Direction.OUT), "id", "left").join(starts.select("id", F.lit(True).alias("s")).distinct(), "id", "left")
    is_start = F.coalesce("s", F.lit(False))
    attr = F.struct(F.when(is_start, 1.0).otherwise(0.0).alias("score"), F.coalesce("incidents", F.lit(0)).alias("out"), is_start.alias("start"))
    walked = Hypergraph(state.select("id", attr.alias("attr")), g.hyperedges)
    old = F.col("attr")
    program = F.struct((F.lit(1 - reset) * F.col("msg") + F.when(old["start"], reset).otherwise(0.0)).alias("score"), old["out"].alias("out"), old["start"].alias("start"))
    share = F.coalesce(F.try_divide(old["score"], old["out"].cast("double")), F.lit(0.0))
    message = F.col("m") / F.col("n_dst")
    done = pregel(walked, program, F.sum, F.lit(0.0), iterations, Direction.OUT, to_dst=F.when(message > 0, message), src={"m": (share, F.sum)})
    return done.vertices.select("id", F.col("attr.score").alias("score"))


def label_propagation(g: Hypergraph, iterations: int = 100) -> DataFrame:
    """(id, label): each side sends the mode of its labels to the other; ties go to the least label."""
    labels = Hypergraph(g.vertices.select("id", F.col("id").alias("attr")), g.hyperedges)
    done = pregel(labels, F.col("msg"), least_mode, None, iterations, Direction.EITHER, to_dst=F.col("a"), to_src=F.col("b"), src={"a": (F.col("attr"), least_mode)}, dst={"b": (F.col("attr"), least_mode)})
    return done.vertices.select("id", F.col("attr").alias("label"))


def lp_partition(g: Hypergraph, k: int, iterations: int = 100, initial: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Placement of vertices (id, pid) and hyperedges (hid, pid) in ``k`` parts by weighted label propagation.

    ``initial``: the first label over id, by default a hash.
    """
    rounds = Rounds(g.vertices.sparkSession)
    edges = rounds.cut(g.hyperedges.select("hid", "src", "dst"))
    inc = rounds.cut(Hypergraph(g.vertices, edges).incidence)
    sizes = edges.select("hid", (F.size("src") + F.size("dst")).alias("n"))
    mean = (edges.agg(F.sum(F.size("src") + F.size("dst"))).first()[0] or 0) // k
    first = initial if initial is not None else F.pmod(F.xxhash64("id"), F.lit(k))
    vertices = rounds.cut(g.vertices.select("id", first.cast("int").alias("pid")))
    held = Rounds(g.vertices.sparkSession)

    def hyperedge_labels(v: DataFrame) -> DataFrame:
        return held.cut(inc.join(v.withColumnRenamed("id", "vid"), "vid").groupBy("hid").agg(least_mode(F.col("pid")).alias("pid")))

    placed = hyperedge_labels(vertices)
    pids = g.vertices.sparkSession.range(k).select(F.col("id").cast("int").alias("pid"))
    for _ in range(iterations if mean else 0):
        load = placed.join(sizes, "hid").groupBy("pid").agg(F.sum("n").cast("double").alias("load"))
        pref = pids.join(load, "pid", "left").select("pid", F.exp((F.lit(float(mean) ** 2) - F.pow(F.coalesce("load", F.lit(0.0)), 2)) / F.lit(float(mean) ** 2)).alias("pref"))  # k rows
        heard = inc.join(placed, "hid").groupBy("vid", "pid").count().join(F.broadcast(pref), "pid")
        best = heard.groupBy("vid").agg(F.max_by("pid", F.struct(F.round(F.col("count") * F.col("pref"), 9), -F.col("pid"))).alias("new"))
        vertices = held.cut(vertices.join(best.withColumnRenamed("vid", "id"), "id", "left").select("id", F.coalesce("new", "pid").alias("pid")))
        placed = hyperedge_labels(vertices)
        held.drop(4)
    return vertices, placed


def _steps(g: Hypergraph) -> DataFrame:
    """(u, v, c): in how many hyperedges u is a source and v a destination."""
    return g.hyperedges.select(F.explode("src").alias("u"), "dst").select("u", F.explode("dst").alias("v")).where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))


def shortest_paths(g: Hypergraph, landmarks: DataFrame, rounds: Rounds, steps: DataFrame) -> list[DataFrame]:
    """For each distance from 0 on a stored (lm, id, sigma): vertices at it and how many shortest paths lead there."""
    level = rounds.cut(landmarks.select(F.col("id").alias("lm"), "id", F.lit(1.0).alias("sigma")).distinct())
    levels = [level]
    seen = level.select("lm", "id")
    while True:
        ahead = level.join(steps, level["id"] == steps["u"]).groupBy("lm", F.col("v").alias("id")).agg(F.sum(F.col("sigma") * F.col("c")).alias("sigma"))
        level = rounds.cut(ahead.join(seen, ["lm", "id"], "left_anti"))
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = seen.union(level.select("lm", "id"))
        if len(levels) % 4 == 0:  # else each round reads one table more
            seen = rounds.cut(seen)


def betweenness(g: Hypergraph, landmarks: DataFrame | None = None, standard: bool = False, seed: int = 0) -> DataFrame:
    """(id, betweenness) from shortest paths out of ``landmarks`` (id; by default 28 picked by hash).

    Endpoints count, and a landmark for itself; ``standard`` leaves them out.
    """
    from .degrees import pick_vertices

    landmarks = pick_vertices(g, 28, seed) if landmarks is None else landmarks
    rounds = Rounds(g.vertices.sparkSession)
    steps = rounds.cut(_steps(g))
    levels = shortest_paths(g, landmarks, rounds, steps)
    below, found = None, []
    for level in reversed(levels):
        if below is None:
            below = rounds.cut(level.withColumn("inf", F.lit(1.0)))
        else:
            b = below.select("lm", F.col("id").alias("v"), (F.col("inf") / F.col("sigma")).alias("share"))
            back = steps.join(b, "v").join(level.select("lm", F.col("id").alias("u")), ["lm", "u"], "left_semi").groupBy("lm", F.col("u").alias("id")).agg(F.sum(F.col("c") * F.col("share")).alias("d"))
            below = rounds.cut(level.join(back, ["lm", "id"], "left").select("lm", "id", "sigma", (1.0 + F.col("sigma") * F.coalesce("d", F.lit(0.0))).alias("inf")))
        found.append(below)
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    every = every.where("lm <> id").withColumn("inf", F.col("inf") - 1) if standard else every
    sums = every.groupBy("id").agg(F.sum("inf").alias("b"))
    return g.vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def scaling(g: Hypergraph) -> DataFrame:
    """(id, s): 1 / sqrt(incidents) of every vertex, 0 without any."""
    return g.vertices.select("id").join(incidents(g), "id", "left").select("id", F.coalesce(1 / F.sqrt("incidents"), F.lit(0.0)).alias("s"))


def _weighted_incidence(g: Hypergraph) -> DataFrame:
    return g.incidence.groupBy("hid", F.col("vid").alias("id")).agg(F.count(F.lit(1)).alias("b")).join(g.to_double_weight().hyperedges.select("hid", F.col("attr").alias("w")), "hid")


def laplacian(g: Hypergraph) -> DataFrame:
    """(row, col, value) of I - S B W B^T S / 2 for vertices with a hyperedge.

    Pairs are made within hyperedges, from their arrays; a hyperedge of n
    members has n^2 entries.
    """
    s = incidents(g).select(F.col("id").alias("vid"), "incidents")
    scaled = g.incidence.join(s, "vid").groupBy("hid").agg(F.sort_array(F.collect_list(F.struct("vid", "incidents"))).alias("m"))
    weighted = scaled.join(g.to_double_weight().hyperedges.select("hid", F.col("attr").alias("w")), "hid")
    # each pair is dealt in one order; both numbers of incidents come along, so that nothing is joined to the pairs
    first = weighted.select("w", "m", F.explode("m").alias("a"))
    pairs = first.select("w", "a", F.explode("m").alias("b")).where("a.vid <= b.vid")
    entries = pairs.groupBy(F.col("a.vid").alias("row"), F.col("b.vid").alias("col")).agg(F.sum(F.col("w") / F.sqrt(F.col("a.incidents") * F.col("b.incidents"))).alias("x"))
    one = F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)
    values = entries.select("row", "col", (one - 0.5 * F.col("x")).alias("value"))
    both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col"))).otherwise(F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))))
    return values.select(F.inline(both), "value")


def laplacian_product(g: Hypergraph, x: DataFrame) -> DataFrame:
    """(id, y): the Laplacian times ``x`` (id, x) without making it; 0 for vertices without a hyperedge."""
    w = _weighted_incidence(g)
    s = scaling(g).join(x, "id")
    sums = w.join(s, "id").groupBy("hid").agg((F.max("w") * F.sum(F.col("b") * F.col("s") * F.col("x"))).alias("yh"))
    y = w.join(sums, "hid").groupBy("id").agg(F.sum(F.col("b") * F.col("yh")).alias("t"))
    return s.join(y, "id", "left").select("id", F.coalesce(F.col("x") - 0.5 * F.col("s") * F.col("t"), F.lit(0.0)).alias("y"))


def sparse_product(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(id, y): ``matrix`` (row, col, value) times ``x`` (id, x)."""
    return matrix.join(x, F.col("col") == F.col("id")).groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("y"))


def spectral(g: Hypergraph, k: int = 3, iterations: int = 10, tolerance: float = 1e-9, sparse: bool = False, seed: int = 0) -> tuple[list[float], DataFrame]:
    """The ``k`` largest Ritz values of the Laplacian, and (id, vector) with an entry for each.

    Lanczos with full orthogonalisation; vectors stay distributed, only dot
    products and the tridiagonal matrix come to the driver.
    """
    rounds = Rounds(g.vertices.sparkSession)
    g = Hypergraph(rounds.cut(g.vertices), rounds.cut(g.hyperedges))
    matrix = rounds.cut(laplacian(g)) if sparse else None
    used = rounds.cut(incidents(g).select("id"))
    start = used.select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1.0).alias("x"))
    norm = float(start.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0)
    if not norm:
        return [], used.select("id", F.array().cast("array<double>").alias("vector"))
    basis = rounds.cut(start.select("id", F.array(F.col("x") / norm).alias("q")))
    t = np.zeros((iterations + 1, iterations + 1))
    size = 0
    for j in range(iterations):
        x = basis.select("id", F.get("q", F.lit(j)).alias("x"))
        y = sparse_product(matrix, x) if sparse else laplacian_product(Hypergraph(used.withColumn("attr", F.lit(0)), g.hyperedges), x)
        both = rounds.cut(basis.join(y, "id"))
        rest = F.col("y")
        for turn in range(2):  # the second pass removes what rounding left
            dots = both.agg(*(F.sum(F.get("q", F.lit(i)) * rest).alias(f"d{i}") for i in range(j + 1))).first()
            if not turn:
                t[j, j] = dots[j]
            for i in range(j + 1):
                rest = rest - F.lit(float(dots[i])) * F.get("q", F.lit(i))
        beta = float(both.agg(F.sqrt(F.sum(rest * rest))).first()[0])
        size = j + 1
        if beta <= tolerance or j + 1 == iterations:
            break
        t[j, j + 1] = t[j + 1, j] = beta
        basis = rounds.cut(both.select("id", F.concat("q", F.array(rest / beta)).alias("q")))
    values, vectors = np.linalg.eigh(t[:size, :size])
    top = np.argsort(values)[::-1][: min(k, size)]
    ritz = F.array(*(sum((F.lit(float(vectors[i, c])) * F.get("q", F.lit(i)) for i in range(size)), F.lit(0.0)) for c in top))
    return [float(values[c]) for c in top], basis.select("id", ritz.alias("vector"))
