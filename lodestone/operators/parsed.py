"""Parsed files: chunks and metadata fields of every file, one pass over each text.

A parser keeps state along a text, which no built-in expresses, so both
operators are Arrow batches. Merging, splitting and previews happen within a
file's own row; files are dealt out once before, since a table of few bytes
is read by few tasks and parsing costs far more than reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..parsing import chunker, metadata

CHUNKS = "file_id long, file_path string, seq int, chunk_type string, name string, content string, start_line int, end_line int, signature string, namespace string, class_name string, parent_context string"


# Chunks of an output batch, about as many as the files of an input batch.
BATCH = 2_000


def _dealt(files: DataFrame, *columns: str) -> DataFrame:
    """The files over all tasks; with a number, so that few bytes are not put together again."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(F.col("file_id").cast("long"), *columns).repartition(max(parts, files.sparkSession.sparkContext.defaultParallelism), "file_id")


def _chunks(least: int, most: int, ceiling: int):
    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file_id", "file_path", *chunker.FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows: list[dict] = []
            for i, path, content in zip(x.file_id, x.file_path, x.content, strict=True):
                rows += [{"file_id": i, "file_path": path} | r for r in chunker.chunk(path or "", content, least, most, ceiling)]
                if len(rows) >= BATCH:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return run


def chunk_files(files: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """files (file_id, file_path, content) -> chunks with their key, sized by the settings. Blank files have none."""
    out = _dealt(files, "file_path", "content").mapInPandas(_chunks(cfg.min_chunk_tokens, cfg.max_chunk_tokens, cfg.overlap_ceiling), CHUNKS)
    return out.withColumn("content", F.substring("content", 1, cfg.chunk_chars)).withColumn("chunk_key", chunk_key())


def chunk_key() -> Column:
    """path:type:name:line, at most 500 letters."""
    return T.cap_key(F.concat_ws(":", "file_path", "chunk_type", "name", F.col("start_line").cast("string")))


def unique_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first chunk of each key, the others): a repeated key loses no other chunk of its file.

    The choice is a small aggregate by key and one join on it, so contents
    are not sorted.
    """
    first = chunks.groupBy("chunk_key").agg(F.min(F.struct("file_id", "seq")).alias("first"))
    x = chunks.join(first, "chunk_key").withColumn("own", F.col("first") == F.struct("file_id", "seq")).drop("first")
    return x.where("own").drop("own"), x.where("not own").drop("own")


def _metadata(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = [metadata.metadata(c) for c in x.content]
        out = pd.DataFrame(rows, columns=list(metadata.FIELDS))
        out.insert(0, "file_id", x.file_id.to_numpy())
        yield out


def extract_metadata(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> the 27 fields as joined text; all are empty where the text is blank."""
    schema = "file_id long, " + ", ".join(f"{f} array<string>" for f in metadata.FIELDS)
    x = _dealt(files, "content").mapInPandas(_metadata, schema)
    return x.select("file_id", *[F.array_join(f, sep or "").alias(f) for f, sep in metadata.FIELDS.items()])
