"""Bulk-synchronous supersteps as a loop of DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Agg, Hypergraph
from ..plans.lineage import Rounds, stored_by
from ..schema import Direction


def pregel(
    g: Hypergraph,
    program: Column,
    merge: Agg,
    initial: Column | None = None,
    max_iterations: int = 1 << 30,
    direction: Direction = Direction.EITHER,
    **send,
) -> Hypergraph:
    """Run ``program`` (over id, attr and msg) until no message comes or ``max_iterations`` is reached.

    First every vertex gets ``initial`` (None: attributes stay); then all
    hyperedges send, as ``send`` says (see :meth:`Hypergraph.map_reduce_tuples`),
    and later those that the receivers of the last messages make active. A
    vertex without a message keeps its attribute.
    """
    spark = g.vertices.sparkSession
    rounds = Rounds(spark)
    edges, links = dealt_by_vertex(g.hyperedges, rounds)
    start = g.vertices if initial is None else g.vertices.withColumn("msg", initial).select("id", program.alias("attr"))
    now = rounds.cut(start.select("id", "attr", F.lit(True).alias("active")), "id")
    held = Rounds(spark)
    for i in range(max_iterations):
        sent = superstep(edges, links, now, merge, direction if i else None, **send).select("id", "msg")
        program_of = F.when(F.col("msg").isNotNull(), program).otherwise(F.col("attr"))
        now = held.cut(now.drop("active").join(sent.hint("shuffle_hash"), "id", "left").select("id", program_of.alias("attr"), F.col("msg").isNotNull().alias("active")), "id", dealt=True)
        held.drop(2)
        if now.where("active").isEmpty():
            break
    return Hypergraph(now.select("id", "attr"), g.hyperedges)


def dealt_by_vertex(hyperedges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """For many supersteps, stored once: the hyperedges by hid and the incidences (vid, hid, is_src) by vid."""
    edges = hyperedges if stored_by(hyperedges, "hid") else rounds.cut(hyperedges, "hid")
    side = lambda c, s: F.struct(F.col(c).alias("ids"), F.lit(s).alias("is_src"))
    links = edges.select("hid", F.inline(F.array(side("src", True), side("dst", False)))).select("hid", "is_src", F.explode("ids").alias("vid"))
    return edges, rounds.cut(links, "vid")


def superstep(
    edges: DataFrame,
    links: DataFrame,
    vertices: DataFrame,
    merge: Agg,
    direction: Direction | None = None,
    to_dst: Column | None = None,
    to_src: Column | None = None,
    src: dict[str, tuple[Column, Agg]] | None = None,
    dst: dict[str, tuple[Column, Agg]] | None = None,
) -> DataFrame:
    """(id, msg) as :meth:`Hypergraph.map_reduce_tuples` has it, over the tables of :func:`dealt_by_vertex`.

    ``vertices`` (id, attr, active) lie by id. All hyperedges send, or with
    ``direction`` those that its active vertices select. Two shuffles: of what
    vertices give to hyperedges, and of what those send back.
    """
    sent = edges.select("hid", "src", "dst", F.col("attr").alias("hattr"), F.size("src").alias("n_src"), F.size("dst").alias("n_dst"))
    if src or dst or direction is not None:
        aggs = [f(F.when(F.col("is_src") == side, v)).alias(name) for side, d in ((True, src), (False, dst)) for name, (v, f) in (d or {}).items()]
        picked = {Direction.OUT: "s", Direction.IN: "d", Direction.EITHER: "s or d", Direction.BOTH: "s and d"}.get(direction, "true")
        if direction is not None:
            hit = F.col("active")
            aggs += [F.max(hit & F.col("is_src")).alias("s"), F.max(hit & ~F.col("is_src")).alias("d")]
        if not dst and direction in (None, Direction.OUT):  # no word of the destinations is heard
            links = links.where(F.col("is_src")) if src else links
        elif not src and direction in (None, Direction.IN):
            links = links.where(~F.col("is_src")) if dst else links
        held = links.join(vertices.withColumnRenamed("id", "vid").hint("shuffle_hash"), "vid")
        sent = sent.join(held.groupBy("hid").agg(*aggs).where(picked).hint("shuffle_hash"), "hid")
    sides = [(n, m) for n, m in (("dst", to_dst), ("src", to_src)) if m is not None]
    rows = sent.select(F.inline(F.array(*(F.struct(F.col(n).alias("ids"), m.alias("msg")) for n, m in sides)))).where("msg is not null")
    return rows.select("msg", F.explode("ids").alias("id")).groupBy("id").agg(merge(F.col("msg")).alias("msg"))
