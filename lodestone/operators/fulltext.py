"""Full-text ranking: a stored index of postings, and Okapi BM25 over the terms of a batch of requests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, HALF = 1.2, 0.75, 10.0
BUCKETS = 64
# More terms than these are joined instead of listed in the scan's filter.
MOST_TERMS = 1000
# A bucket's postings are spread over so many tasks, so a word that is everywhere is no single task's work.
SPREAD = 8
# Words of which a task makes one block of postings for each term. A task holds no more of them at a time.
WORDS = 4_000_000
# Ranges of ids in which the hits of one rank are numbered.
RANGES = 64
# A posting's id is counted from the block's base; lists are narrow where all of a block's documents allow it, else wide.
BLOCK = "term string, base long, ids array<int>, wide_ids array<long>, tfs array<short>, wide_tfs array<int>, dls array<short>, wide_dls array<int>"
STORED = f"n long, {BLOCK}, bucket int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(ids: list[np.ndarray], words: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each term of these documents, its postings ordered by id; last a row without a term, with all ids and lengths."""
    i, dl = np.concatenate(ids), np.concatenate(sizes)
    # Documents are counted in the order of their ids, so one sort by (term, document) orders all postings.
    order = np.argsort(i, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    coded = pa.concat_arrays(words).dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(i) + np.repeat(place, dl)
    found, tf = np.unique(key, return_counts=True)
    term, doc = found // len(i), order[found % len(i)]
    starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), [len(term), len(term) + len(i)])
    rows = len(starts) - 1

    def lists(x: np.ndarray, narrow: pa.DataType, wide: pa.DataType, fits: bool) -> list[pa.Array]:
        own = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, narrow if fits else wide))
        return [own, pa.nulls(rows, pa.list_(wide))] if fits else [pa.nulls(rows, pa.list_(narrow)), own]

    low, high = int(i.min()), int(i.max())
    near, short = high - low < 2**31, int(dl.max()) < 2**15
    base = low if near else 0
    terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    all_ids = np.concatenate([i[doc], i[order]]) - base
    columns = [terms, pa.array(np.full(rows, base), pa.int64()), *lists(all_ids, pa.int32(), pa.int64(), near)]
    for x in (np.concatenate([tf, np.zeros(len(i), tf.dtype)]), np.concatenate([dl[doc], dl[order]])):
        columns += lists(x, pa.int16(), pa.int32(), short)
    return pa.RecordBatch.from_arrays(columns, ["term", "base", "ids", "wide_ids", "tfs", "wide_tfs", "dls", "wide_dls"])


def _list(name: str, of: str) -> Column:
    return F.coalesce(F.col(name).cast(f"array<{of}>"), F.col(f"wide_{name}")).alias(name)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ts) -> blocks of postings. Words are counted within a task, so no word of a document is shuffled by itself."""
    ids, words, sizes, held = [], [], [], 0
    for b in batches:
        ts = b.column(1)
        ids.append(b.column(0).to_numpy())
        sizes.append(np.diff(ts.offsets.to_numpy()))
        words.append(ts.flatten())
        held += len(words[-1])
        if held >= WORDS:
            yield _block(ids, words, sizes)
            ids, words, sizes, held = [], [], [], 0
    if ids and sum(map(len, ids)):
        yield _block(ids, words, sizes)


@dataclass(frozen=True)
class TextIndex:
    """postings (bucket, term, id, tf, dl), terms (bucket, term, df) and stats (n, mean) of a table's text columns.

    Stored postings lie in blocks: a term's row holds those of some documents
    as lists. ``words`` (id, ts) is what an index that is not stored would be
    written from.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None
    words: DataFrame | None = None

    @classmethod
    def over(cls, docs: DataFrame, id_col: str, text_cols: list[str]) -> "TextIndex":
        """The index as plans over docs; nothing is stored. One row of docs for each id."""
        words = docs.select(F.col(id_col).alias("id"), T.tokens(F.concat_ws(" ", *text_cols)).alias("ts"))
        each = words.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
        postings = each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select(bucket(F.col("term")).alias("bucket"), "term", "id", "tf", "dl")
        stats = docs.select(F.regexp_count(F.lower(F.concat_ws(" ", *text_cols)), F.lit(T.WORD)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
        return cls(postings, postings.groupBy("bucket", "term").agg(F.count("*").alias("df")), stats, words=words)

    def write(self, root: str) -> None:
        """Three tables below root, from one pass over the texts; postings and terms lie in folders by the hash of the term, sorted by term, so a search reads few of them.

        Folder -1 of the postings holds each document's length once.
        """
        spark = self.words.sparkSession
        made = self.words.select(F.col("id").cast("long"), "ts").mapInArrow(_blocks, BLOCK)
        ids = _list("ids", "long")
        made = made.select(F.size(ids).cast("long").alias("n"), *made.columns, F.when(F.col("term").isNull(), -1).otherwise(bucket(F.col("term"))).alias("bucket"))
        salt = F.pmod(F.xxhash64(F.col("base"), _list("ids", "long")[0]), F.lit(SPREAD))
        # Without a number, so that few postings make few files.
        dealt = made.repartition("bucket", salt).sortWithinPartitions("bucket", "term")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/postings")
        stored = spark.read.schema(STORED).parquet(f"{root}/postings")
        df = stored.where("bucket >= 0").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        df.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/terms")
        dl = F.aggregate(_list("dls", "int"), F.lit(0).cast("long"), lambda s, x: s + x)
        sums = stored.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sum(dl).alias("dl"))
        sums.select("n", F.try_divide(F.col("dl").cast("double"), "n").alias("mean")).coalesce(1).write.parquet(f"{root}/stats")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "TextIndex":
        blocks = spark.read.schema(STORED).parquet(f"{root}/postings").where("bucket >= 0")
        terms = spark.read.schema("term string, df long, bucket int").parquet(f"{root}/terms").select("bucket", "term", "df")
        return cls(cls._listed(blocks), terms, spark.read.parquet(f"{root}/stats"), blocks)

    @staticmethod
    def _listed(blocks: DataFrame) -> DataFrame:
        x = blocks.select("bucket", "term", "base", F.explode(F.arrays_zip(_list("ids", "long"), _list("tfs", "int"), _list("dls", "int"))).alias("p"))
        return x.select("bucket", "term", (F.col("base") + F.col("p.ids")).alias("id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))

    def matching(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(postings, terms) of the given terms: by filters that reach the scan, or by a join where they are too many to list."""
        asked = terms.select("term").distinct().select("term", bucket(F.col("term")).alias("bucket"))
        named = asked.limit(MOST_TERMS + 1).collect()
        of = (lambda keep: self.postings.transform(keep)) if self.blocks is None else (lambda keep: self._listed(self.blocks.transform(keep)))
        if len(named) > MOST_TERMS:
            keep = lambda df: df.join(asked, ["bucket", "term"])
        else:
            listed = F.col("bucket").isin(sorted({r.bucket for r in named})) & F.col("term").isin(sorted(r.term for r in named)) if named else F.lit(False)
            keep = lambda df: df.where(listed)
        return of(keep), self.terms.transform(keep)


def bm25(index: TextIndex, requests: DataFrame) -> DataFrame:
    """(query_id, id, rank): rank = round(1000 s / (s + HALF)) of the BM25 sum s, 0 to 1000.

    requests (query_id, text), a caller's batch. Only postings of its terms
    are read; they are summed by request and id.
    """
    terms = requests.select("query_id", F.explode(F.array_distinct(T.tokens(T.safe_text(F.col("text"))))).alias("term"))
    postings, df = index.matching(terms)
    s = postings.join(df.select("term", "df"), "term").join(terms, "term").crossJoin(F.broadcast(index.stats))
    idf = F.log(1e0 + (F.col("n") - F.col("df") + 0.5e0) / (F.col("df") + 0.5e0))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = s.select("query_id", "id", part.alias("part")).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("s"))
    return scored.select("query_id", "id", F.round(F.lit(1000e0) * F.col("s") / (F.col("s") + HALF)).cast("int").alias("rank"))


def ranked(hits: DataFrame, floor: int) -> DataFrame:
    """Hits of at least the floor with their position within the request (rank descending, id).

    A request may hit a large part of all rows, and most of them at few ranks,
    so no task gets all its hits, nor all of a rank: rows are numbered within
    one rank and one of RANGES ranges of ids of equal width, and the hits of
    better ranks and lower ranges come before them, which are at most RANGES
    thousand counts for each request. The hits themselves are computed once;
    all uses read the same exchange.
    """
    h = hits.where(F.col("rank") >= floor)
    ends = h.groupBy("query_id").agg(F.min("id").cast("double").alias("low"), F.max("id").cast("double").alias("high"))
    part = F.floor((F.col("id").cast("double") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e0)) * RANGES).cast("int")
    h = h.join(F.broadcast(ends), "query_id").select("query_id", "id", "rank", part.alias("part"))
    better = Window.partitionBy("query_id").orderBy(F.desc("rank"), "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = h.groupBy("query_id", "rank", "part").agg(F.count("*").alias("n"))
    before = counts.select("query_id", "rank", "part", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("query_id", "rank", "part").orderBy("id"))
    x = h.withColumn("own", own).join(before, ["query_id", "rank", "part"])
    return x.select("query_id", "id", "rank", (F.col("before") + F.col("own")).cast("int").alias("pos"))
