"""Parsing of source text: declarations, chunks and metadata fields."""
