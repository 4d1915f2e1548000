"""Exact cosine search of a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cosine_similarity(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0. Vectors of two lengths fail the query."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0e0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    both = F.when(norms == 0, F.lit(0e0)).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of two lengths have no cosine")).cast("double")).otherwise(both)


def l2_normalised(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0e0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(n == 0, F.transform(a, lambda v: v.cast("double"))).otherwise(F.transform(a, lambda v: v.cast("double") / n))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls as one matrix."""
    n = np.diff(lists.offsets.to_numpy())
    if (n != dim).any():
        raise ValueError(f"a vector has {n[n != dim][0]} components, the requests have {dim}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _nearest(names: list[int], matrix: np.ndarray, k: int, most: float):
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The k nearest rows so far of each request, and no more than that.
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in names]
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not len(b):
                continue
            ids, v = b.column(0).to_numpy(), _matrix(b.column(1), matrix.shape[1])
            scale = np.outer(norms, np.linalg.norm(v, axis=1))
            d = np.round(1 - np.divide(matrix @ v.T, scale, out=np.zeros_like(scale), where=scale > 0), 6) + 0.0
            for q, row in enumerate(d):
                near = np.flatnonzero(row <= most)
                own, far = np.concatenate([best[q][0], ids[near]]), np.concatenate([best[q][1], row[near]])
                first = np.lexsort((own, far))[:k]
                best[q] = own[first], far[first]
        for name, (ids, d) in zip(names, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name), pa.int64()), pa.array(ids, pa.int64()), pa.array(d)], ["query_id", "id", "distance"])

    return run


def vector_topk(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 200, max_distance: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, pos): the k nearest of each query within max_distance, ties by id.

    queries (query_id, vector) is a batch of requests and goes to every task;
    a task keeps k rows of a query, so what is ranked in the end grows with
    the tasks and not with the vectors. Distances are rounded to six decimals
    before ranking. Rows without a vector are left out; one of another length
    than the requests' fails the search.
    """
    batch = sorted((r.query_id, r.vector) for r in queries.select("query_id", "vector").collect() if r.vector)
    schema = "query_id long, id long, distance double"
    if not batch:
        return spark.createDataFrame([], schema + ", pos int")
    found = vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(_nearest([q for q, _ in batch], np.array([v for _, v in batch], np.float64), k, max_distance), schema)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


# Rows a fit reads at most, its rounds, and vectors for each cell.
SAMPLE, ROUNDS, CELL = 20_000, 12, 1_000


@dataclass(frozen=True)
class VectorIndex:
    """Vectors in folders by their nearest of a set of centres; a search reads the folders of the nearest few."""

    cells: DataFrame  # (cell, id, vector)
    centres: np.ndarray

    @classmethod
    def build(cls, spark: SparkSession, vectors: DataFrame, root: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> "VectorIndex":
        """Centres are fitted on at most SAMPLE vectors, those of the smallest hashes of ids; every vector is filed.

        cells: as many folders; left out, one for each CELL vectors, and the
        square root of SAMPLE at most, so that the fit has rows for each.
        Vectors that are null or zero lie in folder -1, which every search reads.
        """
        v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
        full = v.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))
        sample = [r.vector for r in full.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
        k = cells or max(1, min(int(np.sqrt(SAMPLE)), full.count() // CELL))
        centres = _centres(np.array(sample, np.float64), k) if sample else np.zeros((0, 1))
        filed = v.mapInArrow(_filed(spark.sparkContext.broadcast(centres)), "cell int, id long, vector array<float>")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        filed.repartition(max(parts, len(centres)), "cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{root}/cells")
        flat = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(flat, "cell int, centre array<double>").coalesce(1).write.parquet(f"{root}/centres")
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "VectorIndex":
        rows = spark.read.parquet(f"{root}/centres").orderBy("cell").collect()
        return cls(spark.read.schema("id long, vector array<float>, cell int").parquet(f"{root}/cells"), np.array([r.centre for r in rows], np.float64))

    def search(self, spark: SparkSession, queries: DataFrame, k: int = 200, max_distance: float = 1.0, probes: int = 8) -> DataFrame:
        """vector_topk over the folders that are among the nearest ``probes`` of any request of the batch."""
        asked = [r.vector for r in queries.select("vector").collect() if r.vector]
        near = {-1}
        for v in asked if len(self.centres) else ():
            near |= set(np.argsort(-(self.centres @ np.array(v, np.float64)), kind="stable")[:probes].tolist())
        return vector_topk(spark, self.cells.where(F.col("cell").isin(sorted(near))), queries, k, max_distance, "id", "vector")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Directions of k groups of the sample, by spherical k-means; fewer where it has fewer rows."""
    u = _unit(sample)
    c = u[np.random.default_rng(7).permutation(len(u))[: min(k, len(u))]]
    for _ in range(ROUNDS if len(c) else 0):
        own = np.argmax(u @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, u)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def _filed(centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            cell = np.full(len(b), -1, np.int32)
            at = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
            if len(at) and len(c):
                v = _matrix(b.column(1).take(pa.array(at)), c.shape[1])
                cell[at] = np.where((v != 0).any(axis=1), np.argmax(v @ c.T, axis=1), -1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1).cast(pa.list_(pa.float32()))], ["cell", "id", "vector"])

    return run
