"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated at random, several times over, and each coordinate
keeps its sign: the unit vector x of these signs is its code. The factor
f = <o, x> is stored with the code, and <x, q> / f estimates <o, q> without
bias. For a pair at cosine t or more the estimate falls short of t by at most
E0 sqrt((1 - f^2) / f^2 / n) sqrt(1 - t^2) for n free coordinates, but for
rounding; the probability of more is that of a normal deviation above E0. The
other vector q travels as signed bytes with a scale and the length of what
rounding left, which widens the bound.

So candidates are judged from codes, factors and bytes. Only vectors of pairs
whose estimate plus bound reaches the threshold are joined with their exact
components, and only the cosine in double precision decides a link.

Candidates are pairs that agree in a band of sign bits. Vectors at cosine c
agree in one sign with probability 1 - acos(c) / pi. The bits of a band grow
with the logarithm of the number of vectors, and there are as many bands as
leave a pair at the threshold without a common one with at most the
probability miss. Buckets are cut into blocks, and a task gets two blocks. A
pair counts in the first band that it shares only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components, local_roots
from .storage import Scratch

BLOCK, OCCUPANCY = 384, 256
E0 = 4.0
# A code has at least so many signs.
SIGNS = 256
# Buckets of more than one block are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_BUCKETS = 100_000
PAIRS = 65_536


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def plan(vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a band, bands)."""
    bits = min(30, max(4, math.ceil(math.log2(max(vectors, 1) / OCCUPANCY + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


class Coder:
    """Codes of vectors of one length, and what is read off them. least: sign bits that the bands need."""

    def __init__(self, dim: int, least: int):
        self.dim, self.turns = dim, max(-(-least // dim), -(-SIGNS // dim))
        self.matrix = np.concatenate([rotation(dim, s) for s in range(self.turns)])  # (signs, dim)
        self.signs = self.turns * dim
        self.row = np.dtype([("c", "<i8"), ("f", "<f4"), ("scale", "<f4"), ("rest", "<f4"), ("code", "u1", (-(-self.signs // 8),)), ("q", "i1", (dim,))])

    def encode(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """One stored row for each row of v, a class of c equal vectors."""
        u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        turned = u @ self.matrix.T
        out = np.zeros(len(v), self.row)
        out["c"], out["code"] = c, np.packbits(turned > 0, axis=1)
        out["f"] = np.abs(turned).sum(axis=1) / np.sqrt(self.signs) / np.sqrt(self.turns)
        out["scale"] = np.abs(u).max(axis=1) / 127
        out["q"] = np.rint(u / out["scale"][:, None])
        out["rest"] = np.linalg.norm(u - out["q"] * out["scale"][:, None], axis=1)
        return out

    def buckets(self, rows: np.ndarray, bits: int, bands: int) -> np.ndarray:
        """(rows, bands): band, length and sign bits as one number."""
        sign = np.unpackbits(rows["code"], axis=1)[:, : bits * bands].reshape(len(rows), bands, bits)
        low = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        return low | np.int64(self.dim) << 30 | np.arange(bands, dtype=np.int64) << 54

    def open_pairs(self, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs whose estimate and bound don't rule out the threshold."""
        x = np.unpackbits(left["code"], axis=1)[:, : self.signs].astype(np.float32)
        x = (2 * x - 1) / np.float32(np.sqrt(self.signs))
        q = (right["q"] * right["scale"][:, None]).astype(np.float32) @ self.matrix.T / np.float32(np.sqrt(self.turns))
        f = left["f"].astype(np.float64)
        bound = E0 * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(self.turns * (self.dim - 1), 1)) * math.sqrt(max(0.0, 1 - threshold * threshold))
        # In two steps, so that no matrix in double precision is made.
        estimate = x @ q.T
        least = ((threshold - bound - 1e-4) * f).astype(np.float32)
        return np.nonzero(estimate >= least[:, None] - right["rest"][None, :])


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, raw, dim); raw null where the vector can't be compared. key tells exact components apart; raw is scaled by a power of two."""
    for b in batches:
        lists = b.column(1)
        at = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64) + 0.0
        at -= at[0]
        before = lambda marks: np.concatenate([[0], np.cumsum(marks)])
        bad, some = before(~np.isfinite(values)), before(values != 0)
        ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        key = K.SpanHash(K.mix(values.view(np.uint64)))(at[:-1], at[1:]).view(np.int64)
        raw = [None] * len(b)
        for k in np.flatnonzero(ok):
            v = values[at[k] : at[k + 1]]
            raw[k] = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, mask=~ok), pa.array(raw, pa.binary()), pa.array(np.where(ok, np.diff(at), 0).astype(np.int32))], ["id", "key", "raw", "dim"])


def matrix(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), dim)


def _coded(least: int):
    """The stored code of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                b = whole.slice(lo, 2048)
                dims = b.column(3).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = b.filter(pa.array(dims == dim))
                    coder = coders.get(dim) or coders.setdefault(dim, Coder(dim, least))
                    stored = coder.encode(matrix(own.column(2), dim), own.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(4), own.column(3), pa.array([r.tobytes() for r in stored], pa.binary()), own.column(2)], ["key", "id", "dim", "stored", "raw"])

    return run


class Stored:
    """Stored rows of a batch by their length of vector."""

    def __init__(self, least: int):
        self.least, self.coders = least, {}

    def __call__(self, stored: list[bytes], dim: int) -> tuple[Coder, np.ndarray]:
        coder = self.coders.get(dim) or self.coders.setdefault(dim, Coder(dim, self.least))
        return coder, np.frombuffer(b"".join(stored), coder.row)


def _banded(bits: int, bands: int, payload: bool):
    """(bucket, key, dim, stored) for each band, or the buckets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Stored(bits * bands)
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = whole.slice(lo, 1024)
                dims = b.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = b.filter(pa.array(dims == dim))
                    coder, rows = read(own.column(2).to_pylist(), dim)
                    bucket = pa.array(coder.buckets(rows, bits, bands).ravel())
                    if payload:
                        take = pa.array(np.repeat(np.arange(len(own)), bands))
                        yield pa.RecordBatch.from_arrays([bucket, own.column(0).take(take), own.column(1).take(take), own.column(2).take(take)], ["bucket", "key", "dim", "stored"])
                    else:
                        yield pa.RecordBatch.from_arrays([bucket], ["bucket"])

    return run


_KEY = ["bucket", "bi", "bj"]


def _sides(table: pa.Table, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(start, end, rows of the left block, of the right one, whether they are one block) of each group with pairs."""
    side, bi, bj = table["side"].to_numpy(), table["bi"].to_numpy(), table["bj"].to_numpy()
    for s, e in zip(at, at[1:], strict=False):
        alone = bool(bi[s] == bj[s])
        l, r = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
        r = l if alone else r
        if len(l) and len(r) and not (alone and len(l) < 2):
            yield int(s), int(e), l, r, alone


def _first_here(keys: np.ndarray, band: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs share no band before this one."""
    out = np.ones(len(i), bool)
    for b in range(band):
        out &= keys[i, b] != keys[j, b]
    return out


def _judge(threshold: float, bits: int, bands: int):
    """(bucket, bi, bj, side, key) of the vectors of pairs that codes don't rule out, in the first band they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Stored(bits * bands)
        for table, at in K.runs(batches, _KEY):
            names, stored, dims, bucket = table["key"].to_numpy(), table["stored"], table["dim"].to_numpy(), table["bucket"].to_numpy()
            for s, e, l, r, alone in _sides(table, at):
                coder, rows = read(stored.slice(s, e - s).to_pylist(), int(dims[s]))
                i, j = coder.open_pairs(rows[l], rows[r], threshold)
                i, j = l[i], r[j]
                if alone:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                first = _first_here(coder.buckets(rows, bits, bands), int(bucket[s]) >> 54, i, j)
                i, j = i[first], j[first]
                left, right = np.unique(i), np.unique(j)
                if alone:
                    left, right = np.union1d(left, right), right[:0]
                own = np.concatenate([left, right])
                if len(own):
                    n, where = len(own), table.slice(s, 1)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, where[c][0].as_py()), t) for c, t in zip(_KEY, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(np.repeat([0, 1], [len(left), len(right)]).astype(np.int32)), pa.array(names[s + own])], [*_KEY, "side", "key"])

    return run


def exact_links(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine at least threshold in double precision."""
    nl, nr = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    i, j = np.nonzero((left / nl[:, None]) @ (right / nr[:, None]).T >= threshold - 1e-9)
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        keep[lo : lo + PAIRS] = np.einsum("ij,ij->i", left[a], right[b]) / (nl[a] * nr[b]) >= threshold
    return i[keep], j[keep]


def _link(threshold: float, bits: int, bands: int):
    """(key, null, links of its vectors to others), and (a, b, 0) for a forest of the links between ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Stored(bits * bands)
        for table, at in K.runs(batches, _KEY):
            names, ids, stored, raw, dims, bucket = table["key"].to_numpy(), table["id"].to_numpy(), table["stored"], table["raw"], table["dim"].to_numpy(), table["bucket"].to_numpy()
            out_a, out_b, out_w = [], [], []
            for s, e, l, r, alone in _sides(table, at):
                coder, rows = read(stored.slice(s, e - s).to_pylist(), int(dims[s]))
                v, c, own_ids = matrix(raw.slice(s, e - s), int(dims[s])), rows["c"], ids[s:e]
                i, j = exact_links(v[l], v[r], threshold)
                i, j = l[i], r[j]
                if alone:
                    i, j = i[i < j], j[i < j]
                first = _first_here(coder.buckets(rows, bits, bands), int(bucket[s]) >> 54, i, j)
                i, j = i[first], j[first]
                if not len(i):
                    continue
                own, at_ = np.unique(np.concatenate([i, j]), return_inverse=True)
                out_a.append(names[s:e][own])
                out_b.append(np.full(len(own), -1))
                out_w.append(np.bincount(at_, np.concatenate([c[j], c[i]])).astype(np.int64))
                x, root = local_roots(own_ids[i], own_ids[j])
                x, root = x[x != root], root[x != root]
                out_a.append(x)
                out_b.append(root)
                out_w.append(np.zeros(len(x), np.int64))
            if out_a:
                w = np.concatenate(out_w)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b), mask=w > 0), pa.array(w)], ["a", "b", "w"])

    return run


def embedding_dedup(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, miss: float = 0.003) -> DataFrame:
    """One row per row: (id_col, n_links, component_id, kept).

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors of different lengths do not link. Equal vectors
    are one class with its number of members, and enter the search once. Rows
    with a null id get n_links 0, a null component_id and kept false. Repeated
    rows count as other vectors. Components are of ids: two classes with one
    smallest id are one node there. Other columns are not read. An
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "embedding-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.keep(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_valid, "id long, key long, raw binary, dim int"), "rows")
    full = rows.where("raw is not null and id is not null")
    classes = scratch.keep(full.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("c"), F.first("raw").alias("raw"), F.first("dim").alias("dim")), "classes")
    bits, bands = plan(classes.count(), threshold, miss)
    codes = scratch.keep(classes.select("key", "c", "raw", "dim", "id").mapInArrow(_coded(bits * bands), "key long, id long, dim int, stored binary, raw binary"), "codes")
    code = codes.select("key", "dim", "stored")

    large = code.mapInArrow(_banded(bits, bands, False), "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = scratch.keep(large.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    if large.count() <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    met = code.mapInArrow(_banded(bits, bands, True), "bucket long, key long, dim int, stored binary").join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    dealt = dealt.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), side, "key", "dim", "stored")
    near = dealt.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_judge(threshold, bits, bands), "bucket long, bi int, bj int, side int, key long")
    exact = near.join(codes, "key").repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_link(threshold, bits, bands), "a long, b long, w long")
    found = scratch.keep(exact, "found")

    root = components(scratch, found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("w").alias("w"))
    by = classes.select("key", F.col("id").alias("rep"), "c").join(links, "key", "left").join(root, F.col("rep") == root.node, "left").select("key", (F.coalesce("w", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    named = full.select("id", "key").join(by, "key").select("id", "n_links", "component_id")
    alone = rows.where("raw is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
