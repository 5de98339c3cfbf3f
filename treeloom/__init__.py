"""Hierarchical retrieval and text analytics as Spark jobs."""
