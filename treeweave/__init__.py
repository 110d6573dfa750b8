"""Spark-first engine for candidate graphs, min-plus merges and tree recovery."""
