"""Degrees, incidences and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Hypergraph
from ..schema import Direction


def neighbour_pairs(g: Hypergraph, direction: Direction) -> DataFrame:
    """Distinct (id, other): In: ``id`` a destination, ``other`` a source of a hyperedge; Out: the reverse; else both.

    Pairs come from the arrays of each hyperedge; nothing is joined.
    """
    def pairs(own: str, other: str):
        return g.hyperedges.select(F.explode(own).alias("id"), other).select("id", F.explode(other).alias("other"))

    found = {Direction.IN: lambda: pairs("dst", "src"), Direction.OUT: lambda: pairs("src", "dst")}.get(direction, lambda: pairs("src", "dst").union(pairs("dst", "src")))()
    return found.distinct()


def degrees(g: Hypergraph, direction: Direction = Direction.EITHER) -> DataFrame:
    """(id, degree): distinct neighbours across hyperedges; vertices without any are absent."""
    return neighbour_pairs(g, direction).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def incidents(g: Hypergraph, direction: Direction = Direction.EITHER) -> DataFrame:
    """(id, incidents): hyperedges with the vertex as destination (In), source (Out), or the sum of both counts."""
    rows = g.incidence
    if direction in (Direction.IN, Direction.OUT):
        rows = rows.where(F.col("is_src") == (direction is Direction.OUT))
    return rows.groupBy(F.col("vid").alias("id")).agg(F.count(F.lit(1)).alias("incidents"))


def hyperedge_degrees(g: Hypergraph, direction: Direction = Direction.EITHER) -> DataFrame:
    """(hid, degree): sources (In), destinations (Out) or both."""
    n = {Direction.IN: F.size("src"), Direction.OUT: F.size("dst")}.get(direction, F.size("src") + F.size("dst"))
    return g.hyperedges.select("hid", n.cast("long").alias("degree"))


def neighbour_ids(g: Hypergraph, direction: Direction = Direction.EITHER) -> DataFrame:
    return neighbour_pairs(g, direction).groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))


def neighbours(g: Hypergraph, direction: Direction = Direction.EITHER) -> DataFrame:
    """(id, neighbours): map of neighbour to attribute."""
    pairs = neighbour_pairs(g, direction).join(g.vertices.withColumnRenamed("id", "other"), "other")
    return pairs.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("other", "attr")))).alias("neighbours"))


def incident_hyperedges(g: Hypergraph, direction: Direction = Direction.EITHER) -> DataFrame:
    """(id, hyperedges): the hyperedges with the vertex as destination (In), source (Out), or both lists."""
    edge = F.struct("hid", "src", "dst", "attr").alias("e")
    side = lambda c: g.hyperedges.select(F.explode(c).alias("id"), edge)
    rows = {Direction.IN: lambda: side("dst"), Direction.OUT: lambda: side("src")}.get(direction, lambda: side("src").union(side("dst")))()
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("hyperedges"))


def pick_vertices(g: Hypergraph, n: int = 1, seed: int = 0) -> DataFrame:
    """Exactly ``n`` vertices (or all), the same ones for a seed: those of least hashes."""
    return g.vertices.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def opposite(edge_src: Column, edge_dst: Column, ids: Column) -> Column:
    """The other side of a hyperedge than the set ``ids``; an error if it is neither."""
    ids = F.sort_array(ids)
    return F.when(edge_src == ids, edge_dst).when(edge_dst == ids, edge_src).otherwise(F.raise_error(F.lit("the set is no side of the hyperedge")))


def relative_direction(edge_src: Column, edge_dst: Column, ids: Column) -> Column:
    ids = F.sort_array(ids)
    return F.when(edge_src == ids, F.lit("out")).when(edge_dst == ids, F.lit("in")).otherwise(F.raise_error(F.lit("the set is no side of the hyperedge")))
