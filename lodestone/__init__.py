"""Hybrid retrieval and corpus processing expressed as Spark plans."""
