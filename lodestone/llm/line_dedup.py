"""Removal of repeated passages by overlapping windows of three lines.

Each run of three consecutive lines of a document is hashed. A hash that
occurs more than once names its first occurrence (smallest id, then position);
every later occurrence covers its lines, covered positions are merged for each
document, and covered lines are cut out of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch, small_batches

WINDOWS = "id long, key long, hashes array<long>, lines array<int>"


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that are not blank: hashes (without white space at the ends), numbers in their rows, count before each row."""
    starts, ends, at = K.spans(~K.SPACE[raw], offsets)
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=breaks[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    number = breaks[starts] - breaks[offsets[:-1]][row]
    first = np.ones(len(starts), bool)
    first[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(starts)) - 1
    h = K.SpanHash(K._BYTE[raw])(starts[begin], ends[last]) if len(begin) else np.zeros(0, np.uint64)
    return h, number[begin].astype(np.int32), np.searchsorted(begin, at)


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, hashes, numbers = [], [], [], []
            for row, raw, offsets in K.chunks(batch.column(2)):
                h, number, at = lines(raw, offsets)
                for i in np.flatnonzero(np.diff(at) >= size):
                    ids.append(row + i)
                    hashes.append(K.shingle_hashes(h[at[i] : at[i + 1]], size))
                    numbers.append(number[at[i] : at[i + 1]])
            if ids:
                take = pa.array(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), K.ragged(np.concatenate(hashes).view(np.int64), [len(x) for x in hashes], pa.int64()), K.ragged(np.concatenate(numbers), [len(x) for x in numbers], pa.int32())], ["id", "key", "hashes", "lines"])

    return run


def info_name(columns: list[str]) -> str:
    """The name of the operator's own column: ``line_dedup``, with as many underscores after it as keep it from a column of the input."""
    name, taken = "line_dedup", {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def line_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """All rows and columns of docs, with text_col cleaned, and a struct column (n_lines, n_removed) named by info_name.

    Lines end at a newline and are compared without ASCII white space at their
    ends; blank lines belong to no window and stay. A document of fewer than
    size lines that are not blank has no window and stays as it is, as do null
    texts and rows with a null id. Where a later occurrence overlaps the first
    in one document, the lines of the first stay. Rows that repeat an id and a
    text count as one document. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "line-dedup")
    key = F.xxhash64(F.col(text_col))
    windows = scratch.keep(small_batches(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text")).mapInArrow(_windows(size), WINDOWS), "windows")
    each = windows.select("id", "key", F.posexplode("hashes").alias("pos", "h"), "lines").select("id", "key", "pos", "h", F.slice("lines", F.col("pos") + 1, size).alias("lines"))
    first = each.groupBy("h").agg(F.min(F.struct("id", "key", "pos")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h", "f")
    later = each.join(first, "h").where("not (id = f.id and key = f.key and pos = f.pos)")
    own = F.when((F.col("id") == F.col("f.id")) & (F.col("key") == F.col("f.key")), F.greatest(F.lit(0), F.col("f.pos") + size - F.col("pos"))).otherwise(F.lit(0))
    cut = later.select("id", "key", F.explode(F.expr("slice(lines, 1, size(lines))")).alias("line"), F.element_at("lines", 1).alias("l0"), "lines", own.alias("own"))
    cut = cut.where("array_position(lines, line) > own").groupBy("id", "key").agg(F.collect_set("line").alias("cut"))

    mark = "__lodestone_"
    d = docs.withColumns({f"{mark}id": F.col(id_col).cast("long"), f"{mark}key": key})
    cut = cut.select(F.col("id").alias(f"{mark}id"), F.col("key").alias(f"{mark}key"), F.array_sort("cut").alias(f"{mark}cut"))
    both = d.join(cut.hint("shuffle_hash"), [f"{mark}id", f"{mark}key"], "left")
    text, gone = f"`{text_col}`", f"{mark}cut"
    kept = F.expr(f"array_join(filter(split({text}, '\\n'), (x, i) -> not array_contains({gone}, i)), '\\n')")
    info = F.struct(F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
    cleaned = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    return both.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], info.alias(info_name(docs.columns)))
