"""Exact n-gram Jaccard self-join with PartEnum signatures, or with prefixes below PARTENUM_FROM.

A document's set holds the hashes of its distinct word n-grams. Two sets of
sizes a and b with Jaccard at least t = num/den differ in at most
(a + b)(den - num)/(den + num) elements. Sizes are cut into bands; within a
band whose largest size is r that bound is k = 2r(den - num)/(den + num).
The feature domain is cut into n1 parts and these into n2 sub-parts; of a
pair in the band at least one part holds at most k2 differences, where
(k2 + 1) n1 > k, so one of the choices of n2 - k2 sub-parts of that part is
equal on both sides. Every such choice is a signature: no qualifying pair is
missed. A set also takes part in the bands of the larger sizes it can match.

That bound holds always. Below a threshold of about 0.9 its choices hold few
features each, and unlike sets meet. There, with miss = 0, sets are sifted and
meet by prefixes, which loses nothing either. Of a set of n features at most
n(den - num)/den are not in a partner. So of the features with a hash in the
lowest part of the domain, which every set shows, all but so many must occur in
another set; most sets without a partner go by that. For those left, features
are ordered by how many sets hold them (in levels, by a map of fixed size), the
rarest first. The first feature in that order that two partners have in common
is among the first n(den - num)/den + 1 of either, so these are the signatures;
a feature that no other set holds needs no signature. Any order that is the same
for all sets would do: collisions in the map cost time, not links.

With miss > 0 a choice is a set of parts that holds about FEATURES features,
and there are as many choices as leave a pair without an equal one with at most
that probability. Choices of several parts overlap, so their number is taken from a
simulation of pairs; choices of one part each never do, and the product of
their probabilities is a bound. Choices without features are left out.

Sets that are equal are one class and enter the join once. Classes that share
a signature are not expanded into pairs: each signature only ties its members
to its smallest one, and the components of these ties are the candidate
clusters. A cluster is cut into blocks of bounded size, and a task gets two
blocks, at first with the sets' sketches only: how many features fall into each
of CELLS cells. The sum of the smaller counts bounds an intersection from
above, so pairs that it keeps below the threshold have no link. For the sets of
the pairs that are left, features are sent; a task counts their intersections
exactly and returns a spanning forest of the links it finds. So no link is
lost, rows stay linear in the documents of a block pair, and a large cluster is
spread over many tasks.
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
from .storage import Scratch, small_batches

U64 = np.uint64
SIGNED = "id long, n long, h1 long, sigs array<long>, sketch binary"
CELLS = 64
BLOCK_DOCS, BLOCK_FEATURES = 64, 100_000
# Places of so many sets are broadcast to where the sets are made; beyond it both are joined by a shuffle.
BROADCAST_SETS = 300_000
BLOOM_BITS, SHARED_BITS = 1 << 23, 1 << 25
PARTS, FEATURES = 64, 10
# Pairs simulated for a band, the share of miss that may be left there, and the largest set whose bands are drawn before the job.
TRIALS, MARGIN, DRAWN = 200_000, 0.7, 2_000
FIRST = 8
# At lower thresholds (num, den), sets meet by prefixes.
PARTENUM_FROM = 9, 10
# Places of the map of levels: four to eight for each feature of several sets, within these powers of two.
LEAST_PLACES, MOST_PLACES = 20, 26


class Bands:
    """Size bands and, for each, the cut of the feature domain."""

    def __init__(self, num: int, den: int, miss: float = 0.0, growth: float = 0.0, two_level_up_to: int = 24):
        self.num, self.den, self.two_level, self.miss = num, den, two_level_up_to, miss
        self.growth, self.low, self.cuts = growth or (1.4 if miss else 1.15), [1, 2], {}

    def _reach(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.growth)))

    def tags(self, n: int) -> range:
        """The bands in which a set of n elements can meet a partner at least as large."""
        most = max(n, n * self.den // self.num)
        self._reach(most)
        first = int(np.searchsorted(self.low, n, "right")) - 1
        return range(first, int(np.searchsorted(self.low, most, "right")))

    def cut(self, tag: int) -> tuple[int, int]:
        """(n1, n2) for the band; n2 is 1 (k2 = 0) or 3 (k2 = 1)."""
        self._reach(self.low[tag])
        k = 2 * (self.low[tag + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        return ((k + 2) // 2, 3) if 1 <= k <= self.two_level else (k + 1, 1)

    def _drawn(self, rng: np.random.Generator, parts: int, each: int, k: int, common: int) -> np.ndarray:
        """Choices of parts, as many as leave at most miss of TRIALS simulated pairs of k differences and common features."""
        differ, filled = np.zeros((TRIALS, parts), bool), np.zeros((TRIALS, parts), bool)
        for lo in range(0, TRIALS, 5000):
            at = np.arange(lo, min(lo + 5000, TRIALS))[:, None]
            differ[at, rng.integers(0, parts, (len(at), k), dtype=np.int32)] = True
            filled[at, rng.integers(0, parts, (len(at), common), dtype=np.int32)] = True
        chosen: list[np.ndarray] = []
        while len(differ) > MARGIN * self.miss * TRIALS:
            if len(chosen) % (parts // each) == 0:
                # Choices cut from one order of the parts don't overlap.
                order = rng.permutation(parts)[: parts // each * each].reshape(-1, each)
            chosen.append(order[len(chosen) % (parts // each)])
            missed = differ[:, chosen[-1]].any(axis=1) | ~filled[:, chosen[-1]].any(axis=1)
            differ, filled = differ[missed], filled[missed]
        return np.array(chosen)

    def choices(self, tag: int) -> tuple[int, np.ndarray]:
        """For miss > 0: the number of parts, and the parts of each choice (choices, parts in each)."""
        if tag not in self.cuts:
            self._reach(self.low[tag])
            most = self.low[tag + 1] - 1
            k = 2 * most * (self.den - self.num) // (self.den + self.num)
            parts = max(PARTS, round(most / FEATURES))
            each = max(1, min(PARTS // 2, round(parts * FEATURES / most)))
            rng = np.random.default_rng(tag)
            if each == 1 and k:
                # Distinct parts are spared less than independently of each other, so the product is a bound.
                spared = (1 - 1 / parts) ** k * (1 - (1 - 1 / parts) ** self.low[tag])
                many = math.ceil(math.log(self.miss) / math.log(1 - spared))
                if many > parts:
                    parts, each = 2 * parts, 2
            if k == 0:
                chosen = np.arange(parts)[None, :]
            elif each == 1:
                chosen = rng.permutation(parts)[:many, None]
            else:
                chosen = self._drawn(rng, parts, each, k, max(1, self.low[tag] - k // 2))
            self.cuts[tag] = parts, chosen
        return self.cuts[tag]


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a sorted set of 64-bit features."""
    out = []
    with np.errstate(over="ignore"):
        sums = np.zeros(len(s) + 1, U64)
        np.cumsum(K.mix(s ^ U64(0xA5A5A5A5DEADBEEF)), out=sums[1:])
        high = s >> U64(32)
        for tag in bands.tags(len(s)):
            n1, n2 = (bands.choices(tag)[0], 1) if bands.miss else bands.cut(tag)
            parts = n1 * n2
            edges = (np.arange(1, parts, dtype=U64) << U64(32)) // U64(parts)
            at = np.concatenate([[0], np.searchsorted(high, edges), [len(s)]])
            part = sums[at[1:]] - sums[at[:-1]]
            if bands.miss:
                part = part[bands.choices(tag)[1]].sum(axis=1, dtype=U64)
            elif n2 == 3:
                part = (part.reshape(n1, 3).sum(axis=1, dtype=U64)[:, None] - part.reshape(n1, 3)).ravel()
            sig = K.mix(part + K.mix(np.arange(len(part), dtype=U64) + U64(tag << 40)))
            out.append(sig[part != 0] if bands.miss else sig)
    return np.concatenate(out)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of distinct n-gram hashes of each row."""
    for _, raw, offsets in K.chunks(column):
        h, at = K.words(raw, offsets)
        for i in range(len(offsets) - 1):
            yield np.unique(K.shingle_hashes(h[at[i] : at[i + 1]], n))


def class_key(s: np.ndarray) -> np.uint64:
    """64 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        both = np.array([s.sum(dtype=U64), K.mix(s).sum(dtype=U64) + U64(len(s))], U64)
        return K.mix(both[:1] ^ K.mix(both[1:]))[0]


def sketch(s: np.ndarray) -> bytes:
    """How many features fall into each cell."""
    return np.bincount((s & U64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype("<u4").tobytes()


def _sign(n: int, num: int, den: int, miss: float, growth: float = 0.0, two_level: int = 24):
    bands = Bands(num, den, miss, growth, two_level)
    for tag in bands.tags(DRAWN) if miss else ():
        for t in range(tag + 1):
            bands.choices(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                b = batch.slice(lo, 2000)
                size, h1, sigs, cells = [], [], [], []
                for s in _sets(b.column(1), n):
                    size.append(len(s))
                    cells.append(sketch(s) if len(s) else None)
                    h1.append(class_key(s))
                    sigs.append(signatures(s, bands) if len(s) else s)
                flat = np.concatenate(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(np.array(h1, U64).view(np.int64)), K.ragged(flat, [len(x) for x in sigs], pa.int64()), pa.array(cells, pa.binary())], ["id", "n", "h1", "sigs", "sketch"])

    return run


def _sample(n: int, num: int, den: int):
    """Rows as of _sign; sigs: the upper 40 bits of the features in the lowest 2(den - num)/den of the domain, each once."""
    edge = U64(min((1 << 64) - 1, (1 << 65) * (den - num) // den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                b = batch.slice(lo, 2000)
                sets = list(_sets(b.column(1), n))
                sigs = [np.unique(s[: np.searchsorted(s, edge, "right")] >> U64(24)) for s in sets]
                h1 = np.array([class_key(s) for s in sets], U64).view(np.int64)
                cells = [sketch(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), K.ragged(np.concatenate(sigs).view(np.int64), [len(x) for x in sigs], pa.int64()), pa.array(cells, pa.binary())], ["id", "n", "h1", "sigs", "sketch"])

    return run


def levels(counts: DataFrame) -> np.ndarray:
    """A map of half a byte a place: the largest level of the features (sig) that fall into it, by the number of sets (c) that hold them."""
    places = 1 << min(MOST_PLACES, max(LEAST_PLACES, (4 * counts.count()).bit_length()))
    at = counts.groupBy(F.col("sig").bitwiseAND(places - 1).alias("at")).agg(F.max(F.expr("least(15, length(bin(c - 1)))")).alias("level"))
    got = at.groupBy(F.shiftright("at", 4).alias("w")).agg(F.expr("bit_or(shiftleft(cast(level as bigint), cast(4 * (at & 15) as int)))").alias("b")).toArrow()
    out = np.zeros(places // 16, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint8)


def _prefixes(level_map, num: int, den: int):
    """(sig, node): of each set (h1, features) the rarest features that a partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = level_map.value
        for batch in batches:
            for lo in range(0, len(batch), 100):
                b = batch.slice(lo, 100)
                lists = b.column(1)
                s, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(size), dtype=np.int32), size)
                at = s & (2 * len(places) - 1)
                level = (places[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15
                apart = size * (den - num) // den
                found = np.bincount(row, weights=level > 0, minlength=len(size)) >= size - apart
                order = np.lexsort((s, level, row))
                first = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size) <= apart[row]
                order = order[first & found[row]]
                order = order[level[order] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(s[order]), b.column(0).take(pa.array(row[order]))], ["sig", "node"])
        K.release()

    return run


def bloom(ids: DataFrame, bits: int = BLOOM_BITS, hashed: bool = False) -> np.ndarray:
    """A bitmap over the hashes of ids, of bits / 8 bytes whatever the number of ids; hashed: they are places in it."""
    at = F.col("id") if hashed else F.pmod(F.xxhash64("id"), F.lit(bits))
    got = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out


def _set_in(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def _shared(bitmap, share: int):
    """(sig, node), each once for a batch, of the signatures in the bitmap; share n: of one signature in n by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            lists = batch.column(1)
            sig, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = _set_in(bits, sig & (SHARED_BITS - 1)) & ((sig >> 40) % share == 0)
            both = pa.table({"sig": sig[keep], "node": np.repeat(batch.column(0).to_numpy(), n)[keep]})
            yield from both.group_by(["sig", "node"]).aggregate([]).select(["sig", "node"]).combine_chunks().to_batches()

    return run


def _features(n: int, wanted):
    """Sets of the documents whose hashed id (third column) is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(_set_in(bits, at)))
            for lo in range(0, len(batch), 500):
                b = batch.slice(lo, 500)
                sets = list(_sets(b.column(1), n))
                key = np.array([class_key(s) for s in sets], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), K.ragged(np.concatenate(sets).view(np.int64), [len(x) for x in sets], pa.int64())], ["id", "h1", "features"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, through their common elements only."""
    a, ia = np.concatenate(left), np.repeat(np.arange(len(left)), [len(x) for x in left])
    b, ib = np.concatenate(right), np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(b, kind="stable")
    b, ib = b[order], ib[order]
    out = np.zeros(len(left) * len(right), np.int64)
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    many = np.cumsum(hi - lo)
    cut = [0, *np.searchsorted(many, np.arange(500_000, many[-1] if len(many) else 0, 500_000)), len(a)]
    for s, e in zip(cut, cut[1:], strict=False):
        times = hi[s:e] - lo[s:e]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out += np.bincount(np.repeat(ia[s:e] * len(right), times) + ib[np.repeat(lo[s:e], times) + within], minlength=len(out))
    return out.reshape(len(left), len(right))


_KEY = ["cluster", "bi", "bj"]


def _sides(table: pa.Table, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(start, end, rows of the left block, of the right one, whether they are one block) of each group with pairs."""
    side, bi, bj = table["side"].to_numpy(), table["bi"].to_numpy(), table["bj"].to_numpy()
    for s, e in zip(at.tolist(), at[1:].tolist(), strict=False):
        alone = bool(bi[s] == bj[s])
        left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
        right = left if alone else right
        if len(left) and len(right) and not (alone and len(left) < 2):
            yield s, e, left, right, alone


def _judge(num: int, den: int):
    """The rows (cluster, bi, bj, side, id, h1) of sets in pairs that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in K.runs(batches, _KEY):
            cells = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u4").reshape(-1, CELLS).astype(np.int64)
            size = cells.sum(axis=1)
            keep = np.zeros(len(table), bool)
            for _, _, left, right, alone in _sides(table, at):
                most = np.zeros((len(left), len(right)), np.int64)
                for c in range(CELLS):
                    most += np.minimum(cells[left, c][:, None], cells[right, c][None, :])
                near = most * den >= (size[left][:, None] + size[right][None, :] - most) * num
                if alone:
                    np.fill_diagonal(near, False)
                keep[left[near.any(axis=1)]] = True
                keep[right[near.any(axis=0)]] = True
            if keep.any():
                yield from table.drop_columns(["sketch"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _compare(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in K.runs(batches, _KEY):
            node = table["id"].to_numpy()
            lists = table["features"].combine_chunks() if isinstance(table["features"], pa.ChunkedArray) else table["features"]
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            found_a, found_b = [], []
            for _, _, left, right, alone in _sides(table, at):
                sl = [values[offsets[i] : offsets[i + 1]] for i in left]
                sr = sl if alone else [values[offsets[i] : offsets[i + 1]] for i in right]
                nl, nr = np.array([len(x) for x in sl]), np.array([len(x) for x in sr])
                inter = intersections(sl, sr)
                i, j = np.nonzero(inter * den >= (nl[:, None] + nr[None, :] - inter) * num)
                a, b = node[left[i]], node[right[j]]
                a, b = a[a != b], b[a != b]
                if len(a):
                    x, root = local_roots(a, b)
                    found_a.append(x[x != root])
                    found_b.append(root[x != root])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SETS else df


def _by_signatures(scratch: Scratch, full: DataFrame) -> DataFrame:
    """(node, root) of the classes that share a signature."""
    rows = full.select(F.explode("sigs").alias("sig"), "h1")
    shared = scratch.keep(rows.groupBy("sig").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("sig", F.col("lo").alias("b")), "shared")
    bitmap = scratch.spark.sparkContext.broadcast(bloom(shared.select(F.col("sig").bitwiseAND(SHARED_BITS - 1).alias("id")), SHARED_BITS, hashed=True))
    # a few signatures tie large groups together; the rest then see one node for each group
    some = full.select("h1", "sigs").mapInArrow(_shared(bitmap, FIRST), "sig long, node long").join(shared, "sig")
    first = components(scratch, some.where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    nodes = full.select("h1", "sigs").join(first, F.col("h1") == F.col("node"), "left").select(F.coalesce("root", "h1").alias("node"), "sigs")
    rest = scratch.keep(nodes.mapInArrow(_shared(bitmap, 1), "sig long, node long").distinct(), "rest")
    least = rest.groupBy("sig").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi").select("sig", "b")
    more = rest.join(least, "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return components(scratch, more.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _by_prefixes(scratch: Scratch, source: DataFrame, full: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, root) of the classes that share a feature of their prefixes.

    Repeated rows only raise counts: more classes are left, or in another order.
    """
    context = scratch.spark.sparkContext
    several = scratch.keep(full.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig"), "several")
    bitmap = context.broadcast(bloom(several.select(F.col("sig").bitwiseAND(SHARED_BITS - 1).alias("id")), SHARED_BITS, hashed=True))
    hits = full.select("h1", "sigs").mapInArrow(_shared(bitmap, 1), "sig long, node long").join(several, "sig").groupBy("node").agg(F.count("*").alias("hits"))
    shown = full.groupBy("h1").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max(F.size("sigs")).alias("shown"))
    left = shown.join(hits, F.col("h1") == F.col("node"), "left").where(f"coalesce(hits, 0) >= shown - n * {den - num} div {den}")
    left = scratch.keep(left.select("id", "h1"), "left")

    wanted = context.broadcast(bloom(left.select("id")))
    sets = source.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)).alias("at")).mapInArrow(_features(n, wanted), "id long, h1 long, features array<long>")
    sets = scratch.keep(sets.join(_few(left), ["id", "h1"]).select("h1", "features"), "sets")
    counts = scratch.keep(sets.select(F.explode("features").alias("sig")).groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    level_map = context.broadcast(levels(counts))
    rest = scratch.keep(sets.mapInArrow(_prefixes(level_map, num, den), "sig long, node long").distinct(), "rest")
    scratch.drop(several, left, sets, counts)
    least = rest.groupBy("sig").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi").select("sig", "b")
    return components(scratch, rest.join(least, "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct())


def ngram_jaccard(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, miss: float = 0.0) -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id).

    Words are runs without ASCII white space, with A-Z taken as a-z. A text of
    fewer than n words is one shingle; a text without words, or null, has an
    empty set, links with nothing and is its own component. Rows with a null
    id keep their n_shingles, get a null component_id and link with nothing.
    Repeated rows stay repeated; rows that share an id are one node, whatever
    their texts. Other columns of docs are not read. An empty table gives an
    empty result. Shingles and sets are told apart by 64-bit hashes.
    """
    scratch = Scratch(spark, "ngram-jaccard")
    source = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    by_prefix = not miss and num * PARTENUM_FROM[1] < den * PARTENUM_FROM[0]
    signed = scratch.keep(source.mapInArrow(_sample(n, num, den) if by_prefix else _sign(n, num, den, miss), SIGNED), "signed")
    full = signed.where("n > 0 and id is not null")
    classes = scratch.keep(full.groupBy("h1").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")

    tied = _by_prefixes(scratch, source, full, n, num, den) if by_prefix else _by_signatures(scratch, full)
    tied = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    placed = scratch.keep(tied.join(classes, tied.node == classes.h1).select("h1", "rep", "n", F.col("root").alias("cluster")), "placed")
    blocks = placed.groupBy("cluster").agg(F.expr(f"cast(greatest(ceil(count(*) / {BLOCK_DOCS}), ceil(sum(n) / {BLOCK_FEATURES})) as int)").alias("blocks"))
    placed = placed.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = scratch.keep(placed.select(F.col("rep").alias("id"), "h1", "cluster", "block", "blocks"), "where")
    here = full.select("id", "h1", "sketch").join(_few(where), ["id", "h1"]).dropDuplicates(["id", "h1"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = here.select("cluster", "id", "h1", "sketch", "block", other).select("cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "h1", "sketch")
    near = dealt.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_judge(num, den), "cluster long, bi int, bj int, side int, id long, h1 long")
    near = scratch.keep(near, "near")

    wanted = spark.sparkContext.broadcast(bloom(near.select("id").distinct()))
    sets = source.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)).alias("at")).mapInArrow(_features(n, wanted), "id long, h1 long, features array<long>")
    each = sets.join(_few(near), ["id", "h1"]).select(*_KEY, "side", "id", "features")
    links = each.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compare(num, den), "a long, b long")
    # The texts of one id are one node: each of their classes is tied to the id.
    several = full.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("id")
    same = full.join(several, "id").select("id", "h1").distinct().join(classes.select("h1", "rep"), "h1").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # A class goes by its smallest id, so the root of a component is its smallest id too.
    root = components(scratch, links.unionByName(same))
    named = classes.select("h1", "rep").join(root, F.col("rep") == root.node, "left").select("h1", F.coalesce("root", "rep").alias("component_id"))
    named = full.select("id", "n", "h1").join(named, "h1").select("id", "n", "component_id")
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
