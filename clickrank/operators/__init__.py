"""Relational operators of the pipeline."""
