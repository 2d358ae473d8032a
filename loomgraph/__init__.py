"""loomgraph: directed property hypergraphs on Spark DataFrames."""
