"""Part of the graph-memory engine."""
