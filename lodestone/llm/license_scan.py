"""License notices in documents, by MinHash bands over overlapping text windows and exact containment.

Templates are filed by length: class m holds those of m/2 < words <= m. Texts
are read in windows of 2m words, one every m, so an occurrence lies whole
within some window of its class. MinHash bands of the window's shingles
retrieve templates; the exact share of a template's shingles found in the
window decides. A minimum that equals a template's is one of the template's
shingles, so windows that hold none of them cannot be retrieved and are not
hashed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .decontaminate import _WORD
from .storage import small_batches

U64 = np.uint64
SHINGLE, HASHES, LEAST = 5, 96, 0.8
# Notices as they are commonly written.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def shingles(column: pa.Array, most: int = K.CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingle hash at each word, words before each row, whether a shingle begins there)."""
    for row, raw, offsets in K.chunks(column, most):
        s, e, at = K.spans(_WORD[raw], offsets)
        h = K.SpanHash(K.BYTE_LOWER[raw])(s, e)
        begin = np.arange(len(h))
        end = np.repeat(at[1:], np.diff(at))
        whole = begin + SHINGLE <= end
        yield row, K.SpanHash(h)(begin, np.minimum(begin + SHINGLE, len(h))), at, whole


class Bands:
    """MinHash of template classes and the rows of a band that keep the collision probability."""

    def __init__(self, templates: dict[str, list[str]], guarantee: float = 0.999):
        texts = [(name, k, t) for name, ts in sorted(templates.items()) for k, t in enumerate(ts)]
        _, h, at, whole = next(shingles(pa.array([t for _, _, t in texts]), 1 << 30))
        n = np.diff(at)
        if (n < SHINGLE).any():
            raise ValueError(f"a template needs {SHINGLE} words")
        self.names = [name for name, _, _ in texts]
        self.sets = [np.unique(h[a:b][whole[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        self.salt = K.seeded(17, HASHES)
        self.classes: dict[int, tuple[list[int], int]] = {}
        for i, words in enumerate(n):
            m = 8
            while m < words:
                m *= 2
            self.classes.setdefault(m, ([], 0))[0].append(i)
        for m, (own, _) in self.classes.items():
            # A match holds at least these shingles of the template, and the window may be full of others.
            shared = {i: math.ceil(LEAST * len(self.sets[i]) - 1e-9) for i in own}
            j = min(shared[i] / (2 * m - SHINGLE + 1 + len(self.sets[i]) - shared[i]) for i in own)
            able = [r for r in (1, 2, 3, 4) if 1 - (1 - j**r) ** (HASHES // r) >= guarantee]
            if not able:
                raise ValueError(f"{HASHES} hashes can't retrieve templates of up to {m} words with probability {guarantee}")
            self.classes[m] = own, max(able)
        self.all = np.unique(np.concatenate(self.sets))
        self.sketch = [self.minhash(s) for s in self.sets]

    def minhash(self, s: np.ndarray) -> np.ndarray:
        return K.mix(s[None, :] ^ self.salt[:, None]).min(axis=1)

    def retrieved(self, m: int, window: np.ndarray) -> Iterator[int]:
        """Templates of class m that share a band with the window."""
        own, r = self.classes[m]
        sketch = self.minhash(window)
        for i in own:
            if (sketch == self.sketch[i])[: HASHES // r * r].reshape(-1, r).all(axis=1).any():
                yield i


def _scan(templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(templates)
        low = np.zeros(1 << 16, bool)
        low[(bands.all & U64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            out: list[tuple] = []
            for row, h, at, whole in shingles(batch.column(1)):
                near = np.flatnonzero(whole & low[(h & U64(0xFFFF)).astype(np.int64)])
                near = near[np.isin(h[near], bands.all)]
                doc = np.searchsorted(at, near, "right") - 1
                for m in bands.classes:
                    k = (near - at[doc]) // m
                    windows = np.unique(np.concatenate([np.stack([doc, k], 1), np.stack([doc, k - 1], 1)[k > 0]]), axis=0) if len(near) else ()
                    for d, w in windows:
                        a, b = at[d] + w * m, min(at[d] + w * m + 2 * m, at[d + 1])
                        inside = h[a : b - SHINGLE + 1]
                        if not len(inside):
                            continue
                        s = np.unique(inside)
                        for i in bands.retrieved(m, s):
                            share = len(np.intersect1d(s, bands.sets[i], assume_unique=True)) / len(bands.sets[i])
                            if share >= LEAST:
                                hit = np.flatnonzero(np.isin(inside, bands.sets[i]))
                                out.append((row + d, bands.names[i], share, int(w * m + hit[0]), int(w * m + hit[-1] + SHINGLE)))
            if out:
                rows, names, share, first, end = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names), pa.array(share), pa.array(first), pa.array(end)], ["id", "license", "containment", "first_word", "end_word"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, containment, first_word, end_word), one row per place where a notice is found.

    Words are runs of letters and digits, A-Z as a-z. containment is the share
    of the template's five-word shingles in the window, at least 0.8; windows
    that find the same words are one row. Texts that are null, or shorter than
    five words, hold no notice; rows with a null id are left out; repeated rows
    count once. Other columns are not read; an empty table gives no rows.
    """
    d = small_batches(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = d.mapInArrow(_scan(templates or TEMPLATES), "id long, license string, containment double, first_word long, end_word long")
    best = hits.groupBy("id", "license", "first_word").agg(F.max(F.struct("containment", "end_word")).alias("x"))
    return best.select(F.col("id").alias(id_col), "license", "x.containment", "first_word", "x.end_word")
