"""Exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .storage import Scratch, small_batches

BLOCK = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = bpe.encoder(path, "library")
        for batch in batches:
            row = 0
            for rows in bpe.texts(batch.column(1)):
                _, counts = encode(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(rows)), pa.array(counts, pa.int64())], ["id", "n_tokens"])
                row += len(rows)

    return run


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) of every row; a null text has no tokens."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_lengths(path), "id long, n_tokens long").withColumnRenamed("id", id_col)


def length_table(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, each also a context limit.

    n_docs; docs_from and tokens_from: documents at least this long and their
    tokens (suffix sums); docs_to and tokens_to: those at most this long;
    truncated_tokens: all tokens left if every text is cut to this length;
    quantile: share of the documents at most this long. Null lengths are not
    counted; an empty table gives an empty result. The sums run within blocks
    of BLOCK lengths and over the blocks' totals, never over all rows at once.
    The histogram is written once, so the texts are encoded once.
    """
    hist = lengths.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("length")).agg(F.count("*").alias("n_docs"))
    hist = Scratch(lengths.sparkSession, "token-counts").keep(hist.withColumn("block", F.floor(F.col("length") / BLOCK)), "histogram")
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    blocks = blocks.select("block", zero(F.sum("bd").over(up)).alias("d0"), zero(F.sum("bt").over(up)).alias("t0"), F.sum("bd").over(all_).alias("d"), F.sum("bt").over(all_).alias("t"))
    w = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.join(blocks, "block").withColumn("docs_to", F.col("d0") + F.sum("n_docs").over(w)).withColumn("tokens_to", F.col("t0") + F.sum(F.col("n_docs") * F.col("length")).over(w))
    return h.select(
        "length",
        "n_docs",
        (F.col("d") - F.col("docs_to") + F.col("n_docs")).alias("docs_from"),
        (F.col("t") - F.col("tokens_to") + F.col("n_docs") * F.col("length")).alias("tokens_from"),
        "docs_to",
        "tokens_to",
        (F.col("tokens_to") + (F.col("d") - F.col("docs_to")) * F.col("length")).alias("truncated_tokens"),
        (F.col("docs_to") / F.col("d")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_to, tokens_to, docs_over, tokens_over, truncated_tokens) of a length_table for any context limits.

    One row for each different limit, also where no document is as long; an
    empty table gives no rows. Each length meets each of the caller's limits
    in a partial sum.
    """
    x = table.select("length", "n_docs", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in sorted(set(limits))])).alias("limit"))
    fits, tokens = F.col("length") <= F.col("limit"), F.col("n_docs") * F.col("length")
    part = lambda where, what: F.sum(F.when(where, what).otherwise(0))
    return x.groupBy("limit").agg(
        part(fits, F.col("n_docs")).alias("docs_to"),
        part(fits, tokens).alias("tokens_to"),
        part(~fits, F.col("n_docs")).alias("docs_over"),
        part(~fits, tokens).alias("tokens_over"),
        F.sum(F.col("n_docs") * F.least("length", "limit")).alias("truncated_tokens"),
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """(length): the shortest length that at least this share of the documents don't exceed; null for an empty table."""
    return table.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))
