"""Spark jobs for contact maps and text corpora."""
