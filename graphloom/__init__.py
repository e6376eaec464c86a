"""Code-graph analytics on Spark: typed nodes and edges as DataFrames, queries as joins over sets."""
