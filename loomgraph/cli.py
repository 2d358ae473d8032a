"""Command line: ``python -m loomgraph.cli TASK INPUT [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import Hypergraph
from .operators import algorithms, degrees, partitioning
from .sources import files

TASKS = ("load", "test", "part", "rw", "lp", "lpp", "bc", "statistics", "laplacian", "spectral", "smrt", "matrix")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("task", choices=TASKS)
    p.add_argument("input")
    p.add_argument("--outputPath")
    p.add_argument("--inputMode", choices=("list", "object", "plist"), default="list")
    p.add_argument("--separator", default=":")
    p.add_argument("--weighted", action="store_true")
    p.add_argument("--numPart", type=int, default=8)
    p.add_argument("--partStrategy", choices=("Plain", "Greedy", "Bi", "Aweto", "Replica"), default="Plain")
    p.add_argument("--objectiveH", type=float, default=0.5, help="cost of degree")
    p.add_argument("--objectiveV", type=float, default=1.0, help="cost of a replica")
    p.add_argument("--objectiveD", type=float, default=0.8, help="cost of demand")
    p.add_argument("--maxIter", type=int)
    p.add_argument("--numStartVertices", type=int)
    p.add_argument("--eigenK", type=int, default=3)
    p.add_argument("--seed", type=int, default=0)
    return p


def load(spark: SparkSession, args) -> Hypergraph:
    if args.inputMode == "object":
        return files.load(spark, args.input)
    if args.inputMode == "plist":
        return files.read_partitioned(spark, args.input, args.separator, args.seed)[0]
    return files.read_list(spark, args.input, args.separator, args.weighted)


def place(g: Hypergraph, args):
    costs = partitioning.Costs(args.objectiveH, args.objectiveV, args.objectiveD)
    return {
        "Plain": lambda: partitioning.plain(g, args.numPart), "Bi": lambda: partitioning.bipartite(g, args.numPart), "Aweto": lambda: partitioning.aweto(g, args.numPart),
        "Greedy": lambda: partitioning.greedy(g, args.numPart, costs=costs), "Replica": lambda: partitioning.replica(g, args.numPart, costs),
    }[args.partStrategy]()


def run(spark: SparkSession, args):
    """The result of a task: a DataFrame that is written if there is an output path, or a value that is printed."""
    g = load(spark, args)
    if args.task == "load":
        return {"vertices": g.num_vertices(), "hyperedges": g.num_hyperedges()}
    if args.task == "test":
        return g.map_tuples(F.lit(0)).hyperedges.agg(F.sum("attr")).first()[0] or 0
    if args.task == "part":
        if args.outputPath:
            files.save(partitioning.partition_by(g, args.numPart, *place(g, args)), args.outputPath)
        return None
    if args.task == "rw":
        n = args.numStartVertices if args.numStartVertices is not None else g.num_vertices() // 1000
        return algorithms.random_walk(g, degrees.pick_vertices(g, n, args.seed), args.maxIter or 10)
    if args.task == "lp":
        return algorithms.label_propagation(g, args.maxIter or 100)
    if args.task == "lpp":
        return files.partitioned_lines(g, algorithms.lp_partition(g, args.numPart, args.maxIter or 100)[1])
    if args.task == "bc":
        return algorithms.betweenness(g, seed=args.seed).where("betweenness > 0")
    if args.task == "statistics":
        return partitioning.statistics(g, args.numPart, *place(g, args))
    if args.task == "laplacian":
        return algorithms.laplacian(g)
    if args.task in ("spectral", "smrt"):
        vectors = algorithms.spectral(g, args.eigenK, args.maxIter or 10, sparse=args.task == "spectral", seed=args.seed)[1]
        return vectors.select("id", F.array_join("vector", " ").alias("vector"))
    x = g.vertices.select("id", (1.0 + F.col("id") % 7).alias("x"))
    sparse = algorithms.sparse_product(algorithms.laplacian(g), x).withColumnRenamed("y", "sparse")
    return algorithms.laplacian_product(g, x).withColumnRenamed("y", "free").join(sparse, "id", "left")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"loomgraph-{args.task}").getOrCreate()
    try:
        out = run(spark, args)
        if hasattr(out, "columns"):
            if args.outputPath:
                files.write_text(out, args.outputPath)
            else:
                out.show(20, False)
        elif out is not None:
            print(out)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
