"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question asked again
with other values keeps its template. Windows of template words of the
documents are hash-joined with those of the benchmark; matched windows of a
document and an item are aligned by the difference of their places, so each
occurrence of an item is judged on its own. An occurrence counts only if its
slots are consistent: one value of the item always stands for one value of the
document and the other way round. Windows with slots are also joined on their
words in lower case, so an exact copy is found however dense its slots are and
whatever its capitals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .ngram_jaccard import BLOOM_BITS, bloom
from .storage import small_batches

U64 = np.uint64
# Units of measure and number words.
UNITS = "mm cm m km mg g kg t ml l s sec min h hr hour hours day days week weeks month months year years minute minutes second seconds inch inches foot feet yard yards mile miles pound pounds ounce ounces meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres dollar dollars cent cents euro euros percent degrees celsius fahrenheit watt watts volt volts joule joules".split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
NUMBER, NAME, UNIT = 1, 2, 3
_SLOT = K.seeded(99, 4)
# Windows of one occurrence may be moved against each other by so many words.
SHIFT = 3

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = _DIGIT.copy()
_WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 59, 63]] = True


def _known(list_of_words: list[str]) -> np.ndarray:
    x = pa.array(list_of_words)
    _, raw, offsets = next(K.chunks(x))
    return np.sort(K.SpanHash(K.BYTE_LOWER[raw])(offsets[:-1], offsets[1:]))


_UNITS, _NUMBERS = _known(UNITS), _known(NUMBER_WORDS)


def template(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all rows: template codes, kinds of slot (0: none), hashes of the words themselves; words before each row."""
    digit = _DIGIT[raw]
    inside = _WORD[raw]
    if len(raw) > 2:
        inside = inside.copy()
        inside[1:-1] |= _POINT[raw[1:-1]] & digit[:-2] & digit[2:]
    starts, ends, at = K.spans(inside, offsets)
    low = raw.copy()
    low[1:] = np.where((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97), raw[1:] + 32, raw[1:])
    h = K.SpanHash(K.BYTE_LOWER[low])(starts, ends)
    kind = np.zeros(len(h), np.int8)
    if not len(h):
        return h, kind, h, at
    first = raw[starts]
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_STOP[raw], out=stops[1:])
    opens = np.ones(len(h), bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    opens[at[:-1][at[:-1] < len(h)]] = True
    kind[capital & ~opens] = NAME
    number = _DIGIT[first] | np.isin(h, _NUMBERS)
    kind[number] = NUMBER
    after = np.zeros(len(h), bool)
    after[1:] = number[:-1]
    kind[after & ~number & np.isin(h, _UNITS)] = UNIT
    return np.where(kind > 0, _SLOT[kind], h), kind, h, at


def _rows(width: int, shortest: int, bits):
    """(hash, id, pos, size, slots) for each window; bits: only those of the bitmap, and only of width shortest.. width.

    With bits, a window joined on its words has all of them as slots, since the item's slots may lie anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if bits is None else bits.value
        for batch in batches:
            for row, raw, offsets in K.chunks(batch.column(1)):
                code, kind, h, at = template(raw, offsets)
                n = np.diff(at)
                span, words, slot = K.SpanHash(code), K.SpanHash(h), np.zeros(len(code) + 1, np.int64)
                np.cumsum(kind > 0, out=slot[1:])
                for w in range(shortest, width + 1):
                    many = np.maximum(n - w + 1, 0) if wanted is not None or w == width else (n == w).astype(np.int64)
                    of = np.repeat(np.arange(len(n)), many)
                    pos = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                    s = at[of] + pos
                    some = slot[s + w] - slot[s]
                    # As templates, and those with slots as they are; without slots both keys are one.
                    for hashes, keep, plain in ((span, 2 * some <= w, False), (words, some > 0, True)):
                        key = hashes(s, s + w).view(np.int64)
                        if wanted is not None:
                            x = K.mix(key.view(U64)) % U64(BLOOM_BITS)
                            keep = keep & ((wanted[(x >> U64(5)).astype(np.int64)] >> (x & U64(31)).astype(np.uint32)) & 1 == 1)
                        if not keep.any():
                            continue
                        rows, first = of[keep], s[keep]
                        grid = first[:, None] + np.arange(w)[None, :]
                        slots = h[grid] if plain and wanted is not None else np.where(kind[grid] > 0, h[grid], U64(0))
                        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), batch.column(0).take(pa.array(row + rows)), pa.array(pos[keep].astype(np.int32)), pa.array(n[rows].astype(np.int32)), K.ragged(slots.view(np.int64).ravel(), np.full(len(first), w), pa.int64())], ["hash", "id", "pos", "size", "slots"])

    return run


_WINDOW = "hash long, id long, pos int, size int, slots array<long>"


Hit = tuple[int, int, int, set[tuple[int, int]]]


def _agree(hits: list[Hit]) -> tuple[int, int, int, int, int] | None:
    """(covered words, first word, end word, slots, changed slots) if the slots of all hits are consistent."""
    of: dict[int, int] = {}
    back: dict[int, int] = {}
    for a, b in (p for h in hits for p in h[3]):
        if of.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return None
    return len(_words(hits)), min(h[0] for h in hits), max(h[0] + h[2] for h in hits), len(of), sum(a != b for a, b in of.items())


def _words(hits: list[Hit]) -> set[int]:
    return {i for h in hits for i in range(h[1], h[1] + h[2])}


def _occurrence(at: dict[int, list[Hit]], shift: int) -> list[Hit]:
    """The hits at one shift, and of those up to SHIFT words beside it what covers further words of the item."""
    hits = list(at[shift])
    covered = _words(hits)
    for near in (shift + sign * by for by in range(1, SHIFT + 1) for sign in (-1, 1)):
        new = [h for h in at.get(near, ()) if not covered.issuperset(range(h[1], h[1] + h[2]))]
        hits += new
        covered |= _words(new)
    return hits


def _judge(share: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One row for a document and an item: the consistent occurrence that covers most of the item, else all hits together."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        at = defaultdict(list)
        for pos, ipos, mine, theirs in zip(x.pos.tolist(), x.ipos.tolist(), x.slots, x.islots, strict=True):
            # No slot in the document's window: the words themselves matched.
            at[pos - ipos].append((pos, ipos, len(theirs), {(a, b or a) for a, b in zip(theirs.tolist(), mine.tolist(), strict=True) if a}))
        hits = [h for hs in at.values() for h in hs]
        least = int(x.isize.iloc[0]) * share
        best = None
        if len(_words(hits)) >= least:
            found = [r for shift in sorted(at) if (r := _agree(_occurrence(at, shift))) and r[0] >= least]
            best = max(found, key=lambda r: (r[0], -r[4], -r[1]), default=None) or _agree(hits)
        r = best or (0, 0, 0, 0, 0)
        return pd.DataFrame({"doc_id": [x.id.iloc[0]], "item_id": [x.item.iloc[0]], "item_words": [x.isize.iloc[0]], "covered_words": [r[0]], "first_word": [r[1]], "end_word": [r[2]], "n_slots": [r[3]], "n_changed": [r[4]], "consistent": [best is not None]})

    return run


def leaks(spark: SparkSession, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8, share: float = 0.5) -> DataFrame:
    """Pairs (doc_id, item_id) of a document that holds an item's template with consistent slots.

    A window has width template words, at least half of them no slots, or is
    joined on its words as they are; an item of fewer words is one window. A
    pair is returned if the matched windows of one occurrence, or all of them
    together, cover at least share of the item's words with consistent slots; the row is of the occurrence that covers most.
    n_changed counts the values that differ (0: the item as it is). Rows whose
    id or text is null, texts without words and empty tables give no pairs.
    Repeated rows count once. Other columns are not read.
    """
    items = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    b = items.mapInArrow(_rows(width, 1, None), _WINDOW).distinct().select("hash", F.col("id").alias("item"), F.col("pos").alias("ipos"), F.col("size").alias("isize"), F.col("slots").alias("islots"))
    shortest = b.agg(F.min(F.size("islots"))).first()[0] or width
    seen = b.select("hash").distinct().mapInArrow(_spread, "id long")
    bits = spark.sparkContext.broadcast(bloom(seen, hashed=True))
    d = small_batches(docs).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = d.mapInArrow(_rows(width, shortest, bits), _WINDOW).join(b, "hash").where("size(slots) = size(islots)").select("id", "item", "pos", "ipos", "isize", "slots", "islots")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = hits.repartition(parts, "id", "item").groupBy("id", "item").applyInPandas(_judge(share), "doc_id long, item_id long, item_words long, covered_words long, first_word long, end_word long, n_slots long, n_changed long, consistent boolean")
    return pairs.where(F.col("consistent") & (F.col("covered_words") >= F.col("item_words") * F.lit(share))).drop("consistent")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = K.mix(b.column(0).to_numpy().view(U64)) % U64(BLOOM_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64))], ["id"])
