"""Composed pipelines: preparation, experiments and summaries."""
