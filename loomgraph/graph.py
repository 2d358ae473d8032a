"""The hypergraph and its relational operators; all are lazy DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.columns import canonical, sides_from_string
from .schema import Direction

Agg = Callable[[Column], Column]


class Hypergraph:
    """``vertices`` (id, attr), one row for each id; ``hyperedges`` (hid, src, dst, attr), sides not empty."""

    def __init__(self, vertices: DataFrame, hyperedges: DataFrame):
        self.vertices, self.hyperedges = vertices, hyperedges

    # construction

    @staticmethod
    def from_hyperedges(hyperedges: DataFrame, default: Column | None = None) -> Hypergraph:
        """Vertices are all that hyperedges refer to, with the attribute ``default`` (0)."""
        ids = hyperedges.select(F.explode(F.array_union("src", "dst")).alias("id")).distinct()
        return Hypergraph(ids.withColumn("attr", F.lit(0) if default is None else default), hyperedges)

    @staticmethod
    def build(vertices: DataFrame, hyperedges: DataFrame, default: Column | None = None) -> Hypergraph:
        """Vertices given and vertices referred to; the latter have ``default``. Of several rows with one id the least attribute counts."""
        given = vertices.groupBy("id").agg(F.min("attr").alias("attr"), F.lit(True).alias("given"))
        used = hyperedges.select(F.explode(F.array_union("src", "dst")).alias("id")).distinct()
        attr = F.when(F.col("given"), F.col("attr")).otherwise(F.lit(0) if default is None else default)
        return Hypergraph(given.join(used, "id", "full").select("id", attr.alias("attr")), hyperedges)

    @staticmethod
    def from_incidence(incidence: DataFrame, hyperedge_attrs: DataFrame | None = None, vertices: DataFrame | None = None, default: Column | None = None) -> Hypergraph:
        """From (hid, vid, is_src), repeated rows allowed; hyperedges that lack a side are left out. One shuffle."""
        side = lambda s: F.sort_array(F.collect_set(F.when(F.col("is_src") == s, F.col("vid"))))
        edges = incidence.groupBy("hid").agg(side(True).alias("src"), side(False).alias("dst")).where((F.size("src") > 0) & (F.size("dst") > 0))
        edges = edges.withColumn("attr", F.lit(1)) if hyperedge_attrs is None else edges.join(hyperedge_attrs, "hid", "left")
        edges = edges.select("hid", "src", "dst", "attr")
        return Hypergraph.from_hyperedges(edges, default) if vertices is None else Hypergraph.build(vertices, edges, default)

    @staticmethod
    def from_tuples(tuples: DataFrame, unique: bool = False, default: Column | None = None) -> Hypergraph:
        """From (src, dst): attribute 1 each, or merged with their multiplicity if ``unique``."""
        rows = tuples.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst"))
        rows = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("attr")) if unique else rows.withColumn("attr", F.lit(1).cast("long"))
        return Hypergraph.from_hyperedges(with_ids(rows).select("hid", "src", "dst", "attr"), default)

    @staticmethod
    def from_strings(lines: DataFrame, separator: str = ";", default: Column | None = None) -> Hypergraph:
        src, dst = sides_from_string(F.col("value"), separator)
        rows = lines.select(src.alias("src"), dst.alias("dst")).where((F.size("src") > 0) & (F.size("dst") > 0)).withColumn("attr", F.lit(1))
        return Hypergraph.from_hyperedges(with_ids(rows).select("hid", "src", "dst", "attr"), default)

    # views

    @cached_property
    def incidence(self) -> DataFrame:
        """(hid, vid, is_src): one scan of the hyperedges, no shuffle."""
        tag = lambda c, s: F.transform(c, lambda v: F.struct(v.alias("vid"), F.lit(s).alias("is_src")))
        return self.hyperedges.select("hid", F.inline(F.concat(tag(F.col("src"), True), tag(F.col("dst"), False))))

    @cached_property
    def tuples(self) -> DataFrame:
        """(hid, src, dst, attr, src_attr, dst_attr): hyperedges with id -> attribute maps of both sides."""
        joined = self.incidence.join(self.vertices.withColumnRenamed("id", "vid"), "vid")
        side = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("is_src") == s, F.struct("vid", "attr"))))
        return self.hyperedges.join(joined.groupBy("hid").agg(side(True).alias("src_attr"), side(False).alias("dst_attr")), "hid")

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_hyperedges(self) -> int:
        return self.hyperedges.count()

    def by_source(self, ids: DataFrame) -> DataFrame:
        """Hyperedges with a source among ``ids`` (id), each once."""
        hids = self.incidence.where("is_src").join(ids.select(F.col("id").alias("vid")), "vid", "left_semi").select("hid").distinct()
        return self.hyperedges.join(hids, "hid", "left_semi")

    def persist(self, level=None) -> Hypergraph:
        for df in (self.vertices, self.hyperedges):
            df.persist(*([level] if level else []))
        return self

    def unpersist(self) -> Hypergraph:
        for df in (self.vertices, self.hyperedges):
            df.unpersist()
        return self

    # maps

    def map_vertices(self, expr: Column) -> Hypergraph:
        """``expr`` over id and attr."""
        return Hypergraph(self.vertices.select("id", expr.alias("attr")), self.hyperedges)

    def map_hyperedges(self, expr: Column) -> Hypergraph:
        """``expr`` over hid, src, dst and attr."""
        return Hypergraph(self.vertices, self.hyperedges.withColumn("attr", expr))

    def map_hyperedge_partitions(self, f, schema) -> Hypergraph:
        """``f`` maps an iterator of pandas frames (hid, src, dst, attr) to one of frames with ``schema``."""
        return Hypergraph(self.vertices, self.hyperedges.mapInPandas(f, schema))

    def map_vertex_partitions(self, f, schema) -> Hypergraph:
        return Hypergraph(self.vertices.mapInPandas(f, schema), self.hyperedges)

    def map_tuples(self, expr: Column, src: dict[str, tuple[Column, Agg]] | None = None, dst: dict[str, tuple[Column, Agg]] | None = None) -> Hypergraph:
        """New hyperedge attributes from incident vertices: ``expr`` over hid, attr and the aggregates (value over vid and attr, function) of each side."""
        sums = self._side_aggregates(self.incidence, src or {}, dst or {})
        return Hypergraph(self.vertices, self.hyperedges.join(sums, "hid", "left").withColumn("attr", expr).select("hid", "src", "dst", "attr"))

    def _side_aggregates(self, incidence: DataFrame, src: dict, dst: dict) -> DataFrame:
        rows = incidence.join(self.vertices.withColumnRenamed("id", "vid"), "vid")
        aggs = [f(F.when(F.col("is_src") == side, v)).alias(name) for side, d in ((True, src), (False, dst)) for name, (v, f) in d.items()]
        return rows.groupBy("hid").agg(*(aggs or [F.count(F.lit(1)).alias("n")]))

    def reverse(self) -> Hypergraph:
        return Hypergraph(self.vertices, self.hyperedges.select("hid", F.col("dst").alias("src"), F.col("src").alias("dst"), "attr"))

    def assign_hyperedge_id(self) -> Hypergraph:
        """The attribute becomes a dense global number in the order of hid."""
        dense = dense_rank_by(self.hyperedges, "hid", "attr")
        return Hypergraph(self.vertices, dense.select("hid", "src", "dst", "attr"))

    def to_double_weight(self) -> Hypergraph:
        is_double = self.hyperedges.schema["attr"].dataType.typeName() == "double"
        return self if is_double else self.map_hyperedges(F.lit(1.0))

    def hyperedge_weights(self) -> DataFrame:
        """(hid, weight) with dense numbers."""
        weights = self.to_double_weight().hyperedges.select("hid", F.col("attr").alias("weight"))
        return dense_rank_by(weights, "hid", "number").select(F.col("number").alias("hid"), "weight")

    def map_reduce_vertices(self, entries: Column, reduce: Agg, where: Column | None = None) -> DataFrame:
        """``entries``: array of struct (key, value) over id and attr; (key, value) after ``reduce``."""
        rows = self.vertices if where is None else self.vertices.where(where)
        return rows.select(F.inline(entries)).toDF("key", "value").groupBy("key").agg(reduce(F.col("value")).alias("value"))

    # filters

    def filter_vertices(self, where: Column) -> DataFrame:
        return self.vertices.where(where)

    def filter_hyperedges(self, where: Column | None = None, vertex: Column | None = None) -> DataFrame:
        """Hyperedges for which ``where`` (over hid, src, dst, attr) holds, and ``vertex`` (over id and attr) for every incident vertex."""
        kept = self.hyperedges if where is None else self.hyperedges.where(where)
        if vertex is None:
            return kept
        broken = self.incidence.join(self.vertices.where(~F.coalesce(vertex, F.lit(False))).select(F.col("id").alias("vid")), "vid", "left_semi").select("hid").distinct()
        return kept.join(broken, "hid", "left_anti")

    def filter_tuples(self, where: Column) -> DataFrame:
        """Hyperedges for which ``where`` holds over their tuple: the attributes of every vertex of a side stand in it by id."""
        return self.hyperedges.join(self.tuples.where(where).select("hid"), "hid", "left_semi")

    def subgraph(self, hyperedge: Column | None = None, every_vertex: Column | None = None, vertex: Column | None = None) -> Hypergraph:
        """Vertices by ``vertex``; hyperedges by ``hyperedge`` and ``every_vertex``, apart from each other: hyperedges keep all members."""
        return Hypergraph(self.vertices if vertex is None else self.vertices.where(vertex), self.filter_hyperedges(hyperedge, every_vertex))

    def filter(self, prepare: Callable[[Hypergraph], Hypergraph], hyperedge: Column | None = None, every_vertex: Column | None = None, vertex: Column | None = None) -> Hypergraph:
        """Filter on what ``prepare`` derives, with the attributes of this hypergraph."""
        return self.mask(prepare(self).subgraph(hyperedge, every_vertex, vertex))

    # joins

    def mask(self, other: Hypergraph) -> Hypergraph:
        """What both have, with the attributes of this one; hyperedges are equal if their sides are."""
        return Hypergraph(self.vertices.join(other.vertices, "id", "left_semi"), self.hyperedges.join(other.hyperedges, ["src", "dst"], "left_semi").select("hid", "src", "dst", "attr"))

    def left_join(self, other: DataFrame, expr: Column) -> DataFrame:
        """(id, attr): ``expr`` over id, attr and ``other_attr`` (null where ``other`` (id, attr) lacks the id)."""
        return self._joined(other, "left", expr)

    def inner_join(self, other: DataFrame, expr: Column) -> DataFrame:
        return self._joined(other, "inner", expr)

    def _joined(self, other: DataFrame, how: str, expr: Column) -> DataFrame:
        one = other.groupBy("id").agg(F.min("attr").alias("other_attr"))
        return self.vertices.join(one, "id", how).select("id", expr.alias("attr"))

    def outer_join_vertices(self, other: DataFrame, expr: Column) -> Hypergraph:
        return Hypergraph(self.left_join(other, expr), self.hyperedges)

    def join_vertices(self, other: DataFrame) -> Hypergraph:
        """Attributes of ``other`` where it has the id."""
        return self.outer_join_vertices(other, F.coalesce("other_attr", "attr"))

    def diff(self, other: DataFrame) -> DataFrame:
        """(id, attr of ``other``) of vertices that both have with different attributes."""
        o = other.select("id", F.col("attr").alias("other_attr"))
        return self.vertices.join(o, "id").where(~F.col("attr").eqNullSafe(F.col("other_attr"))).select("id", F.col("other_attr").alias("attr"))

    def upsert(self, other: DataFrame) -> DataFrame:
        """All ids of both; attributes of ``other`` first."""
        o = other.select("id", F.col("attr").alias("other_attr"))
        return self.vertices.join(o, "id", "full").select("id", F.coalesce("other_attr", "attr").alias("attr"))

    def align(self, other: DataFrame) -> DataFrame:
        """Rows of ``other`` whose id is a vertex."""
        return other.join(self.vertices.select("id"), "id", "left_semi")

    def hyperedge_inner_join(self, other: Hypergraph, expr: Column) -> DataFrame:
        """(hid, src, dst, attr): ``expr`` over src, dst, attr and other_attr, for each pair of hyperedges with equal sides."""
        o = other.hyperedges.select("src", "dst", F.col("attr").alias("other_attr"))
        return self.hyperedges.join(o, ["src", "dst"]).select("hid", "src", "dst", expr.alias("attr"))

    def group_hyperedges(self, merge: Agg = F.sum) -> Hypergraph:
        """One hyperedge for those with equal sides; it has the least hid."""
        merged = self.hyperedges.groupBy("src", "dst").agg(F.min("hid").alias("hid"), merge(F.col("attr")).alias("attr"))
        return Hypergraph(self.vertices, merged.select("hid", "src", "dst", "attr"))

    # message passing

    def active_hyperedges(self, active: DataFrame, direction: Direction) -> DataFrame:
        """(hid), each once: Out wants an active source, In an active destination, Either any, Both both."""
        hits = self.incidence.join(active.select(F.col("id").alias("vid")), "vid", "left_semi").groupBy("hid").agg(F.max("is_src").alias("s"), F.max(~F.col("is_src")).alias("d"))
        wanted = {Direction.OUT: "s", Direction.IN: "d", Direction.EITHER: "s or d", Direction.BOTH: "s and d"}[direction]
        return hits.where(wanted).select("hid")

    def map_reduce_tuples(
        self,
        merge: Agg,
        to_dst: Column | None = None,
        to_src: Column | None = None,
        src: dict[str, tuple[Column, Agg]] | None = None,
        dst: dict[str, tuple[Column, Agg]] | None = None,
        active: DataFrame | None = None,
        direction: Direction = Direction.EITHER,
    ) -> DataFrame:
        """(id, msg): what hyperedges send to their vertices, merged.

        ``src`` and ``dst``: aggregates of each side, as in :meth:`map_tuples`.
        ``to_dst``, ``to_src``: the message to every vertex of that side, over
        hid, hattr, n_src, n_dst and the aggregates; a null is not sent. Only
        hyperedges that ``active`` (id) selects send, with all their members.
        """
        edges = self.hyperedges
        if active is not None:
            edges = edges.join(self.active_hyperedges(active, direction), "hid", "left_semi")
        part = Hypergraph(self.vertices, edges)
        sent = edges.select("hid", "src", "dst", F.col("attr").alias("hattr"), F.size("src").alias("n_src"), F.size("dst").alias("n_dst"))
        if src or dst:
            sent = sent.join(part._side_aggregates(part.incidence, src or {}, dst or {}), "hid")
        none = F.lit(None)
        to = lambda ids, m: F.transform(F.col(ids), lambda v: F.struct(v.alias("id"), F.col(m).alias("msg")))
        sides = [(n, m) for n, m in (("dst", to_dst), ("src", to_src)) if m is not None]
        sent = sent.select("src", "dst", *((m if m is not None else none).alias(f"m_{n}") for n, m in sides))
        rows = sent.select(F.inline(F.concat(*(to(n, f"m_{n}") for n, _ in sides)))).where("msg is not null")
        # partial aggregation combines the messages before the shuffle
        return self.align(rows.groupBy("id").agg(merge(F.col("msg")).alias("msg")))

    def map_reduce_tuples_pandas(self, f, schema: str, merge: Agg, active: DataFrame | None = None, direction: Direction = Direction.EITHER) -> DataFrame:
        """For message functions that columns can't express: ``f`` maps frames of :attr:`tuples` to frames (id, msg), any message to any vertex.

        Only hyperedges that ``active`` (id) selects are mapped, with all their members.
        """
        part = self
        if active is not None:
            part = Hypergraph(self.vertices, self.hyperedges.join(self.active_hyperedges(active, direction), "hid", "left_semi"))
        return self.align(part.tuples.mapInPandas(f, schema).groupBy("id").agg(merge(F.col("msg")).alias("msg")))


def dense_rank_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows 0, 1, ... in the order of a unique long ``key``, without one task for all rows.

    Rows are sorted in ranges of nearly equal size, whatever the spread of the
    keys; the counts of the ranges are summed up.
    """
    from .plans.lineage import Rounds

    low = F.lit((1 << 33) - 1)  # a monotonic id is the number of the range and, below it, that of the row
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    ranged = Rounds(df.sparkSession).cut(ranged).withColumn("range", F.shiftright("at", 33))
    counts = ranged.groupBy("range").count()
    before = counts.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "range").withColumn(name, F.col("before") + F.col("at").bitwiseAND(low)).drop("range", "at", "before")  # a row for each range


def with_ids(rows: DataFrame) -> DataFrame:
    """Add ``hid``: unique, not dense."""
    return rows.withColumn("hid", F.monotonically_increasing_id())
