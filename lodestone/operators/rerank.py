"""Reranking of retrieved rows, with its fallback, and the shape of what a search returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from .hybrid import passes_gate, rerank_fallback

Scorer = Callable[[Column, Column], Column]
# Keys of a result's metadata.
SEARCH_KEYS = "_file_path class_name chunk_type chunk_name start_line end_line namespace signature score match_source vector_rrf chunk_fts_rrf file_fts_rrf distance".split()
FALLBACK_KEYS = "class_name base_class methods properties enum_values file_type".split()


def lexical_support(match_source: Column, chunk_rrf: Column | None, file_rrf: Column | None) -> Column:
    """Whether a text leg found the row; by its source where the terms are missing; unknown counts as yes."""
    by_source = F.coalesce(match_source != "Vector", F.lit(True))
    if chunk_rrf is None or file_rrf is None:
        return by_source
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0e0))
    return F.when(chunk_rrf.isNull() & file_rrf.isNull(), by_source).otherwise((number(chunk_rrf) > 0) | (number(file_rrf) > 0))


def parse_scores(body: DataFrame) -> DataFrame:
    """body (query_id, json) of a scoring service -> (query_id, position, rerank_score).

    Both a bare array and an object with "results" are read; a result's score
    is relevance_score, else score, else 0. Broken answers have no rows.
    """
    item = "array<struct<index: long, relevance_score: double, score: double>>"
    rows = F.coalesce(F.from_json("json", f"struct<results: {item}>")["results"], F.from_json("json", item))
    x = body.select("query_id", F.explode(rows).alias("r")).where("r.index is not null")
    return x.select("query_id", F.col("r.index").alias("position"), F.coalesce("r.relevance_score", "r.score", F.lit(0e0)).alias("rerank_score"))


def join_scores(rows: DataFrame, scores: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """rows (query_id, position, lexical, ...) by their scores, gated, best first.

    Positions without a row are ignored. A query with one row, or without any
    score, keeps its rows in their order and has no score; one whose rows all
    fall to the gate has none.
    """
    s = rows.join(scores, ["query_id", "position"], "left")
    w = Window.partitionBy("query_id")
    s = s.withColumn("n", F.count("*").over(w)).withColumn("scored", F.count("rerank_score").over(w))
    plain = (F.col("n") == 1) | (F.col("scored") == 0)
    s = s.withColumn("near", passes_gate(cfg)).where(plain | F.col("near"))
    both = s.withColumn("rerank_score", F.when(~plain, F.col("rerank_score"))).drop("n", "scored", "near")
    order = w.orderBy(F.desc_nulls_last("rerank_score"), "position")
    return both.withColumn("pos", F.row_number().over(order))


def rerank(hits: DataFrame, scorer: Scorer | None, cfg: Settings = Settings(), n_results: int | None = None) -> DataFrame:
    """hits (query_id, pos, question, content, lexical, ...): the first rerank_pool of each query, scored, cut, gated.

    scorer maps (question, content) to a score and may give null where it has
    no answer; those rows take the fallback's scores, which keep their order.
    The cut to n_results comes before the gate, so gated rows are not filled up.
    """
    n = n_results or cfg.n_results
    pool = hits.where(F.col("pos") <= (max(n, cfg.rerank_pool) if scorer else n)).withColumn("position", F.col("pos") - 1).drop("pos")
    if scorer is None:
        return pool.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("pos", (F.col("position") + 1).cast("int"))
    w = Window.partitionBy("query_id")
    s = pool.withColumn("raw", scorer(F.col("question"), F.col("content")))
    s = s.withColumn("s", F.when(F.count("raw").over(w) < F.count("*").over(w), rerank_fallback(F.col("position"))).otherwise(F.col("raw"))).drop("raw")
    top = s.withColumn("place", F.row_number().over(w.orderBy(F.desc("s"), "position"))).where(F.col("place") <= n).drop("place")
    rows, scores = top.drop("s"), top.select("query_id", "position", F.col("s").alias("rerank_score"))
    return join_scores(rows, scores, cfg)


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, vector_backed, dropped): rows whose source is not the text alone, and rows the gate took."""
    b = before.groupBy("query_id").agg(F.count("*").alias("had"), F.count_if(F.col("match_source") != "FullText").alias("vector_backed"))
    a = after.groupBy("query_id").agg(F.count("*").alias("kept"))
    return b.join(a, "query_id", "left").select("query_id", "vector_backed", (F.col("had") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def shaped(rows: DataFrame, keys: list[str], cfg: Settings = Settings(), keep_first: bool = True) -> DataFrame:
    """(query_id, pos, id, document, metadata): text values, null as empty; long contents cut, but for the first row."""
    have = [k for k in keys if k in rows.columns]
    entries = [x for k in have for x in (F.lit(k), F.coalesce(F.col(k).cast("string"), F.lit("")))]
    meta = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    if "rerank_score" in rows.columns:
        stamp = F.create_map(F.lit("rerank_score"), T.score_text(F.col("rerank_score")))
        meta = F.when(F.col("rerank_score").isNull(), meta).otherwise(F.map_concat(meta, stamp))
    place = F.col("pos") - 1 if keep_first else F.lit(1)
    return rows.select("query_id", "pos", F.col("file_path").alias("id"), T.truncated(F.coalesce("content", F.lit("")), place, cfg.max_content).alias("document"), meta.alias("metadata"))
