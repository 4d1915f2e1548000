"""Pluggable models: tokenizers, embedders and rerankers, applied in Arrow batches."""
