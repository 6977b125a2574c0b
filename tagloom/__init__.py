"""Code-map analytics on Spark: tags, edges, ranks, search, traversal and snapshots as DataFrame plans."""
