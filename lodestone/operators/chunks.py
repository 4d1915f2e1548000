"""Chunk maintenance as windows: merging undersized runs, previews of the next sibling, greedy splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def merge_undersized(chunks: DataFrame, least: int = 50) -> DataFrame:
    """chunks (file_id, seq, name, content): runs of two or more undersized neighbours become one chunk.

    Returns (file_id, seq, chunk_type, name, content); seq is the run's first.
    """
    w = Window.partitionBy("file_id").orderBy("seq")
    small = T.token_estimate(F.col("content")) < least
    x = chunks.withColumn("small", small).withColumn("edge", (~F.col("small") | ~F.coalesce(F.lag("small").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("run", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("file_id", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "content"))).alias("m"))
    join = lambda part, sep: F.array_join(F.transform("m", lambda r: r[part]), sep)
    return g.select("file_id", F.col("m")[0]["seq"].alias("seq"), F.when(F.size("m") > 1, "members").otherwise("line").alias("chunk_type"), join("name", "+").alias("name"), join("content", "\n\n").alias("content"))


def sibling_overlap(chunks: DataFrame, ceiling: int = 380, marker: str = "// next: ") -> DataFrame:
    """Append the next chunk's preview to chunks below the ceiling; the last of a file stays."""
    nxt = F.lead("content").over(Window.partitionBy("file_id").orderBy("seq"))
    x = chunks.withColumn("nxt", nxt)
    grown = F.concat("content", F.lit("\n" + marker), T.preview(F.col("nxt")))
    return x.withColumn("content", F.when(F.col("nxt").isNotNull() & (T.token_estimate(F.col("content")) < ceiling), grown).otherwise(F.col("content"))).drop("nxt")


def _split(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for i, content in zip(x.id, x.content, strict=True):
            parts, held, size = [], [], 0
            for line in (content or "").split("\n"):
                n = len(line.split()) * 6 // 5
                if held and size + n > most:
                    parts.append("\n".join(held))
                    held, size = [], 0
                held.append(line)
                size += n
            parts.append("\n".join(held))
            rows += [(i, k + 1, len(parts), p) for k, p in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["id", "part", "parts", "content"])


def split_oversized(chunks: DataFrame, most: int = 400) -> DataFrame:
    """(id, content) -> (id, part, parts, content): whole lines packed greedily up to the budget."""
    return chunks.mapInPandas(lambda it: _split(it, most), "id long, part int, parts int, content string")
