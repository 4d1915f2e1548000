"""Typed settings with validated ranges, read from flat JSON maps."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace


# The defaults, and below the ranges.
@dataclass(frozen=True)
class Settings:
    vector_weight: int = 60
    chunk_weight: int = 30
    file_weight: int = 30
    rrf_k: int = 60
    vector_candidates: int = 200
    vector_probes: int = 8
    max_distance: float = 1.0
    min_fts_rank: int = 10
    rerank_pool: int = 30
    min_score_ratio: float = 0.1
    min_top_score: float = 1e-6
    min_vector_only_score: float = 0.05
    embedding_dimension: int = 1536
    max_content: int = 1500
    hosted_file_cap: int = 1000
    n_results: int = 5
    chat_results: int = 8
    min_chunk_tokens: int = 50
    max_chunk_tokens: int = 400
    overlap_tokens: int = 50
    overlap_ceiling: int = 380
    chunk_chars: int = 5000
    promotion_ratio: float = 0.95
    fuzzy_min_length: int = 8
    fuzzy_edits: int = 3
    include: str = "**/*.cs"
    exclude: str = "**/bin/**;**/obj/**"

    def merged(self, values: dict[str, str]) -> "Settings":
        """Known names with valid values replace the current ones; the rest is ignored."""
        new = {}
        for f in fields(self):
            raw = values.get(f.name)
            if raw is None:
                continue
            try:
                x = type(getattr(self, f.name))(raw)
            except ValueError:
                continue
            low, high, open_low = RANGES.get(f.name, (None, None, False))
            if low is not None and not (low < x <= high if open_low else low <= x <= high):
                continue
            new[f.name] = x
        return replace(self, **new)

    @classmethod
    def load(cls, *paths: str) -> "Settings":
        """Later files override earlier ones; missing or broken files change nothing."""
        out = cls()
        for p in paths:
            if os.path.exists(p):
                try:
                    with open(p, encoding="utf-8") as f:
                        values = json.load(f)
                except (OSError, ValueError):
                    continue
                if isinstance(values, dict):
                    out = out.merged({k: str(v) for k, v in values.items()})
        return out


RANGES = {"max_distance": (0.0, 2.0, True), "min_score_ratio": (0.0, 1.0, False), "min_top_score": (0.0, 1.0, False), "min_vector_only_score": (0.0, 1.0, False)}
