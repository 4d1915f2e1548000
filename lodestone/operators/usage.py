"""Facets, health, cache and answer lookups, telemetry, and the context of grounded answers."""

from __future__ import annotations

import logging
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def facets(files: DataFrame, col: str = "file_type") -> DataFrame:
    """Counts by the raw value, shown with "(none)" for null and for blank: two rows where both occur."""
    shown = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("(none)"))
    return files.groupBy(col).agg(F.count("*").alias("n")).select(shown.alias("name"), "n").orderBy(F.desc("n"), "name")


def index_health(chunks: DataFrame, has_index: bool) -> DataFrame:
    s = chunks.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    status = F.when(F.col("total") == 0, "Red").when(F.col("embedded") == 0, "Red").when(F.col("embedded") < F.col("total"), "Yellow").when(F.lit(not has_index), "Yellow").otherwise("Green")
    return s.withColumn("status", status).withColumn("healthy", F.col("status") == "Green")


def cache_lookup(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, answer, level) by the exact question, else by its normal form; of several entries the last."""
    exact = cache.groupBy("query").agg(F.max_by("answer", "seq").alias("exact"))
    loose = cache.groupBy(T.question(F.col("query")).alias("norm")).agg(F.max_by("answer", "seq").alias("loose"))
    x = asked.join(exact, "query", "left").withColumn("norm", T.question(F.col("query"))).join(loose, "norm", "left")
    return x.select("id", F.coalesce("exact", "loose").alias("answer"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "normalised").otherwise("miss").alias("level"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("level") != "miss")
    return lookups.agg(F.count("*").alias("asked"), hits.alias("hits"), F.count_if(F.col("level") == "miss").alias("misses"), F.round(F.coalesce(hits / F.nullif(F.count("*"), F.lit(0)), F.lit(0e0)), 6).alias("hit_rate"))


def usage_rows(events: DataFrame, question: Column, kind: Column, duration: Column) -> DataFrame:
    """Append-ready usage facts: heartbeats left out, questions cut to 400 letters, durations as whole numbers."""
    q = F.substring(F.trim(F.coalesce(question, F.lit(""))), 1, 400)
    whole = F.least(F.greatest(duration.cast("long"), F.lit(0)), F.lit(2147483647)).cast("int")
    return events.select("event_id", "ts", kind.alias("event_type"), q.alias("question"), whole.alias("duration_ms")).where(F.lower(F.trim("question")) != T.GUARD)


def top_queries(cache: DataFrame, query: str = "query", n: int = 10) -> DataFrame:
    """The n queries asked most often, of equal ones the first by value."""
    return cache.groupBy(query).agg(F.count("*").alias("n")).orderBy(F.desc("n"), query).limit(n)


def feedback_line() -> Column:
    """One log line for a row (ts, question, answer, helpful): time, rating, question and answer, each on one line."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    rating = F.when(F.col("helpful"), "UP").otherwise("DOWN")
    return F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), rating, F.concat(F.lit("Q:"), flat("question")), F.concat(F.lit("A:"), flat("answer")))


_WRITER = ThreadPoolExecutor(1, "usage")


def append_later(rows: DataFrame, path: str, kind: str = "parquet") -> Future:
    """Append facts or log lines in the background; a failure is logged, gives False, and never reaches the request."""

    def write() -> bool:
        try:
            rows.write.mode("append").format(kind).save(path)
            return True
        except Exception as e:  # whatever it is, the request that made the rows goes on
            logging.getLogger(__name__).warning("usage was not written to %s: %s", path, str(e)[:200])
            return False

    return _WRITER.submit(write)


def observed_top(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, observed_top): the best score that belongs to a row of the query; null where none does."""
    s = rows.select("query_id", "position").join(scores, ["query_id", "position"], "left")
    return s.groupBy("query_id").agg(F.max("rerank_score").alias("observed_top"))


def chat_context(hits: DataFrame) -> DataFrame:
    """hits (query_id, pos, source, content) -> (query_id, context, sources, grounded): contents in rank order, sources as first seen."""
    x = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "content"))).alias("h"))
    text = F.array_join(F.transform("h", lambda r: F.concat(F.lit("// File: "), r["source"], F.lit("\n"), r["content"], F.lit("\n\n"))), "")
    return x.select("query_id", text.alias("context"), F.array_join(F.array_distinct(F.transform("h", lambda r: r["source"])), "|").alias("sources"), T.grounded(text).alias("grounded"))
