"""Spark-first retrieval, graph and text analytics: every operator is DataFrame in, DataFrame out."""
