"""Hybrid search: three ranked legs fused by weighted reciprocal ranks, rerank order, and the relevance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from .fulltext import TextIndex, bm25, ranked
from .vectors import VectorIndex, vector_topk


def rrf(weight: int, pos: str, k: int) -> Column:
    return F.coalesce(F.lit(float(weight)) * (1e0 / (k + F.col(pos))), F.lit(0e0))


# A chunk's columns that full text reads; of a file it reads all that hold text.
CHUNK_TEXT = "content name chunk_key class_name namespace signature parent_context".split()


def chunk_text(chunks: DataFrame) -> list[str]:
    return [c for c in CHUNK_TEXT if c in chunks.columns]


def file_text(files: DataFrame) -> list[str]:
    return [f.name for f in files.schema if f.dataType.typeName() == "string"]


def hybrid_search(spark: SparkSession, requests: DataFrame, files: DataFrame, chunks: DataFrame, top_n: int = 20, cfg: Settings = Settings(), chunk_type: str | None = None, file_index: TextIndex | None = None, chunk_index: TextIndex | None = None, vector_index: VectorIndex | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """One row per hit of each request: ids, score, the three terms, distance, source and position.

    requests (query_id, text, vector); files (file_id and text columns); chunks
    (chunk_id, file_id, chunk_type, embedding and text columns). Every chunk of
    a matched file is a candidate; chunk_type filters the vector and the chunk
    leg only, after ranks are given; a blank text leaves out both text legs.
    Stored indexes are read where they are given; else the tables are. Where
    vectors (chunk_id, embedding) are a table of their own, chunks need none,
    and only the vector leg meets them. Payload is joined by the caller, after
    the limit.
    """
    own = chunks if chunk_type is None else chunks.where(F.col("chunk_type") == chunk_type)
    if vector_index is None or chunk_type is not None:
        embedded = own if vectors is None else own.select("chunk_id").join(vectors, "chunk_id")
        v = vector_topk(spark, embedded.where("embedding is not null"), requests, cfg.vector_candidates, cfg.max_distance, "chunk_id", "embedding")
    else:
        v = vector_index.search(spark, requests, cfg.vector_candidates, cfg.max_distance, cfg.vector_probes)
    v = v.select("query_id", F.col("id").alias("chunk_id"), "distance", F.col("pos").alias("vpos"))
    asked = requests.where(F.col("text").rlike(r"\S"))
    hits = bm25(chunk_index or TextIndex.over(chunks, "chunk_id", chunk_text(chunks)), asked)
    if chunk_type is not None:
        hits = hits.join(own.select(F.col("chunk_id").alias("id")), "id", "left_semi").select("query_id", "id", "rank")
    c = ranked(hits, cfg.min_fts_rank).select("query_id", F.col("id").alias("chunk_id"), F.col("pos").alias("cpos"))
    f = ranked(bm25(file_index or TextIndex.over(files, "file_id", file_text(files)), asked), cfg.min_fts_rank).select("query_id", F.col("id").alias("file_id"), F.col("pos").alias("fpos"))
    ids = chunks.select("chunk_id", "file_id")
    by_file = f.join(ids, "file_id").select("query_id", "chunk_id", "fpos")
    legs = v.select("query_id", "chunk_id", "distance", "vpos", F.lit(None).cast("int").alias("cpos"), F.lit(None).cast("int").alias("fpos"))
    legs = legs.unionByName(c, allowMissingColumns=True).unionByName(by_file, allowMissingColumns=True)
    # Dealt by both keys: the legs' union must not claim a partitioning by request, which would put each in one task.
    legs = legs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id", "chunk_id")
    one = legs.groupBy("query_id", "chunk_id").agg(*[F.max(x).alias(x) for x in ("distance", "vpos", "cpos", "fpos")])
    s = one.withColumn("vector_rrf", rrf(cfg.vector_weight, "vpos", cfg.rrf_k)).withColumn("chunk_fts_rrf", rrf(cfg.chunk_weight, "cpos", cfg.rrf_k)).withColumn("file_fts_rrf", rrf(cfg.file_weight, "fpos", cfg.rrf_k))
    text = (F.col("chunk_fts_rrf") > 0) | (F.col("file_fts_rrf") > 0)
    source = F.when((F.col("vector_rrf") > 0) & text, "Hybrid").when(F.col("vector_rrf") > 0, "Vector").otherwise("FullText")
    s = s.withColumn("score", F.round(F.col("vector_rrf") + F.col("chunk_fts_rrf") + F.col("file_fts_rrf"), 6)).withColumn("match_source", source)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = s.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top_n)
    rounded = [F.round(x, 6).alias(x) for x in ("vector_rrf", "chunk_fts_rrf", "file_fts_rrf")]
    # The few best of each request go to the chunks, which stay where they are.
    return ids.join(F.broadcast(top), "chunk_id").select("query_id", "pos", "chunk_id", "file_id", "score", *rounded, "distance", "match_source")


def rerank_fallback(position: Column) -> Column:
    """Scores that keep the order where no reranker answered; never zero."""
    return 1e0 - 0.001e0 * position


def passes_gate(cfg: Settings = Settings()) -> Column:
    """Whether a scored row is near the best score of its query (see relevance_gate)."""
    top = F.max("rerank_score").over(Window.partitionBy("query_id"))
    floor = top * cfg.min_score_ratio
    floor = F.when(F.coalesce("lexical", F.lit(True)), floor).otherwise(F.greatest(floor, F.lit(cfg.min_vector_only_score)))
    return (top >= cfg.min_top_score) & (F.col("rerank_score") >= floor)


def relevance_gate(scored: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Keep rows near the best score of their query.

    scored (query_id, position, rerank_score, lexical): lexical null counts as
    supported. A query whose best score is below min_top_score keeps nothing.
    """
    return scored.withColumn("near", passes_gate(cfg)).where("near").drop("near")
