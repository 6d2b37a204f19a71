"""Search, ranking, chunking, graph and lifecycle operators."""
