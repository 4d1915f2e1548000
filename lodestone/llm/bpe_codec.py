"""Encoding of documents to token ids and decoding back, by prefix-sharing trie traversal."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .storage import small_batches


class Decoder:
    """Texts of id arrays as the vocabulary file's own decoder makes them: byte-level, or the tokens' strings with a space between."""

    def __init__(self, path: str, names: list[str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        special = {x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(bpe.byte_letters())}
        pieces = [x.encode() if i in special else bytes(back[c] for c in x) for i, x in enumerate(names)] if self.byte_level else [x.encode() + b" " for x in names]
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        size = self.size[ids]
        raw = bpe.gather(self.flat, self.start[ids], size)
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[np.cumsum(counts)]
        if self.byte_level:
            starts = np.concatenate([[0], ends[:-1]])
            return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)], pa.string())
        # the space after a row's last token goes
        last = ends[counts > 0] - 1
        keep = np.ones(len(raw), bool)
        keep[last] = False
        lengths = np.diff(np.concatenate([[0], ends])) - (counts > 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])


def _codec(path: str, method: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = bpe.encoder(path, method)
        decode = Decoder(path, names)
        for batch in batches:
            row = 0
            for rows in bpe.texts(batch.column(1)):
                ids, counts = encode(rows)
                offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(rows)), pa.array(counts, pa.int64()), binary, decode(ids, counts)], ["id", "n_tokens", "ids", "decoded"])
                row += len(rows)

    return run


def bpe_codec(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", method: str = "trie") -> DataFrame:
    """One row per row of docs: (id_col, n_tokens, ids, decoded).

    ids: the text's token ids as little-endian unsigned 32-bit integers, as the
    tokenizers library gives them without special tokens; decoded: the text
    that these ids decode to. A null or empty text has no ids and decodes to
    "". A text with letters outside the tabled ranges, or with the beginning of
    a special token, is encoded by the library itself. Null ids of rows,
    repeated rows and other columns pass or stay unread; an empty table gives
    an empty result.
    """
    out = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_codec(path, method), "id long, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
