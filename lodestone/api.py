"""The engine's entry points as functions over tables: search, files by name, context, health, and index builds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as T
from .models.tokenizers import instructed
from .operators import hybrid, lexical, parsed, rerank, usage
from .operators.fulltext import TextIndex
from .operators.vectors import VectorIndex
from .sources.files import capped, file_id
from .sources.store import Store

Embedder = Callable[[Column], Column]
Answerer = Callable[[Column, Column], Column]


class Engine:
    """Searches over one index: files with their metadata, and chunks with their vectors.

    Without an embedder, searches are lexical and marked as degraded.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, scorer: rerank.Scorer | None = None, cfg: Settings = Settings(), hosted: bool = False, file_index: TextIndex | None = None, chunk_index: TextIndex | None = None, vector_index: VectorIndex | None = None, answerer: Answerer | None = None):
        self.spark, self.files, self.chunks, self.embedder, self.scorer, self.cfg, self.hosted = spark, files, chunks, embedder, scorer, cfg, hosted
        self.file_index, self.chunk_index, self.vector_index, self.answerer = file_index, chunk_index, vector_index, answerer

    @classmethod
    def open(cls, spark: SparkSession, store: Store, embedder: Embedder | None = None, model: str = "", **kw) -> "Engine":
        """The live version; a model other than the one its vectors were made with is refused."""
        made = store.manifest().get("model", "")
        if embedder is not None and made != model:
            raise ValueError(f"the index holds vectors of {made!r}, not of {model!r}")
        at = store.indexed()
        indexes = {"file_index": TextIndex.open(spark, f"{at}/files"), "chunk_index": TextIndex.open(spark, f"{at}/chunks"), "vector_index": VectorIndex.open(spark, f"{at}/vectors")} if at else {}
        return cls(spark, store.read("files"), store.read("chunks"), embedder, **indexes | kw)

    def embed(self, df: DataFrame, kind: str = "query", text: str = "text", out: str = "vector") -> DataFrame:
        if self.embedder is None:
            raise ValueError("no embedder is set")
        return df.withColumn(out, self.embedder(instructed(F.coalesce(text, F.lit("")), kind, self.hosted)))

    def hits(self, queries: DataFrame, n: int | None = None, module_filter: str | None = None) -> DataFrame:
        """Ranked, reranked and gated rows with their payload; module_filter is taken and has no effect."""
        n = n or self.cfg.n_results
        pool = max(n, self.cfg.rerank_pool) if self.scorer else n
        asked = self.embed(queries)
        found = hybrid.hybrid_search(self.spark, asked, self.files, self.chunks, pool, self.cfg, None, self.file_index, self.chunk_index, self.vector_index)
        payload = self.chunks.select("chunk_id", "file_path", F.col("class_name"), "chunk_type", F.col("name").alias("chunk_name"), "content", "start_line", "end_line", "namespace", "signature")
        rows = found.join(payload, "chunk_id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
        lexical_hit = rerank.lexical_support(F.col("match_source"), F.col("chunk_fts_rrf").cast("string"), F.col("file_fts_rrf").cast("string"))
        return rerank.rerank(rows.withColumn("lexical", lexical_hit), self.scorer, self.cfg, n)

    def search(self, queries: DataFrame, n: int | None = None) -> DataFrame:
        """queries (query_id, text) -> (query_id, pos, id, document, metadata, degraded)."""
        if self.embedder is None:
            asked = queries.select("query_id", "text").collect()  # a caller's batch of questions
            parts = [self._lexical(q.text or "", n or self.cfg.n_results).withColumn("query_id", F.lit(q.query_id)) for q in asked]
            out = parts[0] if parts else self._lexical("", 1).withColumn("query_id", F.lit(0)).limit(0)
            for p in parts[1:]:
                out = out.unionByName(p)
            return rerank.shaped(out, rerank.FALLBACK_KEYS, self.cfg).withColumn("degraded", F.lit(True))
        x = self.hits(queries, n).withColumn("_file_path", F.col("file_path"))
        return rerank.shaped(x, rerank.SEARCH_KEYS, self.cfg).withColumn("degraded", F.lit(False))

    def _lexical(self, question: str, n: int) -> DataFrame:
        top = lexical.fallback(self.spark, self.files, question, n, self.file_index).select("file_path", "pos")
        return top.join(self._named(), "file_path")

    def _named(self) -> DataFrame:
        return self.files.withColumns({"methods": F.col("method_names"), "properties": F.col("property_names")})

    def search_by_filename(self, name: str, n: int = 5) -> DataFrame:
        """Files whose path holds the name, by path; every content is cut."""
        x = lexical.filename_search(self._named(), name, n).withColumn("query_id", F.lit(0))
        x = x.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("file_path")))
        return rerank.shaped(x, rerank.FALLBACK_KEYS, self.cfg, keep_first=False)

    def chat(self, queries: DataFrame, n: int | None = None) -> DataFrame:
        """One row for each query: context in rank order, sources as first seen, whether there is anything to answer from, and the answer.

        The answerer maps (question, context) to an answer and is asked only where
        something was retrieved; else the fixed answer is given. Without one
        other answers are null.
        """
        x = self.search(queries, n or self.cfg.chat_results)
        found = usage.chat_context(x.select("query_id", "pos", F.col("id").alias("source"), F.col("document").alias("content")))
        all_ = queries.select("query_id", F.col("text").alias("question")).join(found, "query_id", "left")
        all_ = all_.withColumns({"context": F.coalesce("context", F.lit("")), "sources": F.coalesce("sources", F.lit("")), "grounded": F.coalesce("grounded", F.lit(False))})
        own = F.lit(None).cast("string") if self.answerer is None else F.when(F.col("grounded"), self.answerer(F.col("question"), F.col("context")))
        listed = T.source_list(F.split("sources", r"\|"))
        return all_.withColumn("answer", F.coalesce(T.answer_guard(F.col("context")), F.concat(own, listed)))

    def retry(self, queries: DataFrame, n: int | None = None) -> DataFrame:
        """chat once more for questions whose answer was turned down, asked for more detail."""
        return self.chat(queries.withColumn("text", F.concat(F.lit(T.MORE_DETAIL), F.coalesce("text", F.lit("")))), n)

    def systems(self) -> DataFrame:
        return usage.facets(self.files, "file_type")

    def collections(self, name: str = "files") -> DataFrame:
        return self.files.agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count")

    def health(self, has_index: bool | None = None) -> DataFrame:
        """has_index: whether there is a vector index; left out, whether this engine has one."""
        known = self.vector_index is not None if has_index is None else has_index
        return usage.index_health(self.chunks, known).crossJoin(self.files.agg(F.count("*").alias("files")))


def feedback_rows(rows: DataFrame) -> DataFrame:
    """rows (ts, question, answer, helpful) -> usage facts with the verdict UP or DOWN."""
    return rows.select("ts", F.lit("feedback").alias("event_type"), F.substring(F.trim(F.coalesce("question", F.lit(""))), 1, 400).alias("question"), F.when(F.col("helpful"), "UP").otherwise("DOWN").alias("verdict"))


def visit_rows(requests: DataFrame) -> DataFrame:
    """requests (ts, method, path, address) -> (ts, client_ip) of page loads only."""
    page = (F.upper("method") == "GET") & F.lower("path").isin("/", "/index.html")
    return requests.where(page).select("ts", T.client_ip(F.col("address")).alias("client_ip"))


def build_index(spark: SparkSession, listed: DataFrame, store: Store, embedder: Embedder, model: str, cfg: Settings = Settings(), local_model: bool = True, hosted: bool = False, on_cap: Callable[[int, int], None] | None = None, dimension: int | None = None) -> bool:
    """listed (file_path, content) -> a new live version, if at least promotion_ratio of the files were read and chunked.

    Files that could not be read have null content and are not staged; a file
    that is not blank must have a chunk to count. A repeated chunk key goes to
    the table "duplicates" instead of losing the rest of its file. Vectors of a
    length other than dimension fail the build. Full-text and vector indexes
    are part of the version. Nothing changes for readers until the manifest is
    switched; a failed build leaves the live version as it was.
    """
    total = listed.count()
    if not local_model and total > cfg.hosted_file_cap and on_cap:
        on_cap(total, cfg.hosted_file_cap)
    files = capped(listed, cfg.hosted_file_cap, local_model).withColumn("file_id", file_id(F.col("file_path"))).where("content is not null")
    version = store.stage({"files": files.join(parsed.extract_metadata(files), "file_id")})
    expected = min(total, cfg.hosted_file_cap) if not local_model else total
    if not store.complete(version, "files", expected, cfg.promotion_ratio):
        return False
    live = f"{store.root}/{version}"
    staged = spark.read.parquet(f"{live}/files")
    kept, again = parsed.unique_chunks(parsed.chunk_files(staged, cfg))
    vector = embedder(instructed(F.col("content"), "passage", hosted))
    kept = kept.withColumn("chunk_id", F.xxhash64("chunk_key")).withColumn("embedding", vector if dimension is None else T.of_dimension(vector, dimension))
    store.add(version, {"chunks": kept, "duplicates": again})
    chunks = spark.read.parquet(f"{live}/chunks")
    chunked = chunks.select("file_id").distinct().count() + staged.where(~F.col("content").rlike(r"\S")).count()
    if chunked < int(staged.count() * cfg.promotion_ratio):
        return False
    at = store.indexes(version)
    TextIndex.over(staged, "file_id", hybrid.file_text(staged)).write(f"{at}/files")
    TextIndex.over(chunks, "chunk_id", hybrid.chunk_text(chunks)).write(f"{at}/chunks")
    VectorIndex.build(spark, chunks, f"{at}/vectors", "chunk_id", "embedding")
    store.promote(version, model=model, files=str(total), last_run=str(int(time.time())))
    return True
