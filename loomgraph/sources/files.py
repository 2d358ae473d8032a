"""Reading and writing hypergraphs: list files, partitioned list files, parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import set_from_string
from ..graph import Hypergraph, with_ids


def _fields(spark: SparkSession, path: str, separator: str, least: int) -> DataFrame:
    """``parts`` of the lines that aren't empty, don't begin with ``#`` and have ``least`` fields; the separator is literal."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & F.contains("value", F.lit(separator)))
    parts = F.split("value", r"\Q" + separator + r"\E")
    return lines.select(parts.alias("parts")).where(F.size("parts") >= least)


def read_list(spark: SparkSession, path: str, separator: str = ":", weighted: bool = False, default: Column | None = None) -> Hypergraph:
    """Lines ``v v SEP v v [SEP weight]``; attributes are weights (1.0 where one is missing) if ``weighted``, else 0.

    Lines with an empty side make no hyperedge.
    """
    rows = _fields(spark, path, separator, 2)
    at = lambda i: F.get("parts", F.lit(i))
    attr = F.coalesce(F.expr("try_cast(trim(get(parts, 2)) as double)"), F.lit(1.0)) if weighted else F.lit(0)
    edges = rows.select(set_from_string(at(0)).alias("src"), set_from_string(at(1)).alias("dst"), attr.alias("attr")).where((F.size("src") > 0) & (F.size("dst") > 0))
    return Hypergraph.from_hyperedges(with_ids(edges).select("hid", "src", "dst", "attr"), default)


def read_partitioned(spark: SparkSession, path: str, separator: str = ":", seed: int = 0) -> tuple[Hypergraph, DataFrame, DataFrame]:
    """Lines ``pid SEP v v SEP v v``: the hypergraph, placement of hyperedges (hid, pid) and of vertices (id, pid).

    A vertex goes to one of the partitions it occurs in, picked by a seeded hash.
    """
    rows = _fields(spark, path, separator, 3)
    at = lambda i: F.get("parts", F.lit(i))
    edges = with_ids(rows.select(F.trim(at(0)).cast("int").alias("pid"), set_from_string(at(1)).alias("src"), set_from_string(at(2)).alias("dst")).where((F.size("src") > 0) & (F.size("dst") > 0)))
    placed = edges.select(F.explode(F.array_union("src", "dst")).alias("id"), "pid").groupBy("id").agg(F.min_by("pid", F.xxhash64("pid", "id", F.lit(seed))).alias("pid"))
    return Hypergraph.from_hyperedges(edges.select("hid", "src", "dst", F.lit(0).alias("attr"))), edges.select("hid", "pid"), placed


def save(graph: Hypergraph, path: str, mode: str = "error") -> None:
    graph.vertices.write.mode(mode).parquet(f"{path}/vertices")
    graph.hyperedges.write.mode(mode).parquet(f"{path}/hyperedges")


def load(spark: SparkSession, path: str) -> Hypergraph:
    return Hypergraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/hyperedges"))


def list_lines(graph: Hypergraph, separator: str = ":") -> DataFrame:
    return graph.hyperedges.select(F.concat_ws(separator, F.array_join("src", " "), F.array_join("dst", " ")).alias("value"))


def partitioned_lines(graph: Hypergraph, placement: DataFrame, separator: str = " : ") -> DataFrame:
    """(value): ``pid : srcs : dsts``, which :func:`read_partitioned` reads."""
    return graph.hyperedges.join(placement, "hid").select(F.concat_ws(separator, F.col("pid").cast("string"), F.array_join("src", " "), F.array_join("dst", " ")).alias("value"))


def write_text(df: DataFrame, path: str, separator: str = ",") -> None:
    """Rows as text lines of their columns."""
    df.select(F.concat_ws(separator, *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.text(path)
