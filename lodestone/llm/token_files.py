"""Token ids in binary shards, each document compressed by itself with one shared zstandard dictionary.

A folder of token files holds

    manifest.json            width of an id, end id, name of the dictionary
    <hash>.dict              the dictionary, named by its hash
    shards/*                 the shards, in ascending order of the documents' ids
    index/*.parquet          of each shard: file, order, first and last id, numbers of documents and tokens

and a shard is

    magic "LTK2" | width of an id (u8) | hash of the dictionary (16 bytes)
    | partition (u32) | shard in it (u32) | tokens before it in its partition (u64)
    | documents (u32) | per document: id (i64), tokens (u32), end of its frame (u32)
    | frames, one after the other | newline

All integers are little-endian. Any document can be read from its frame alone.
Shards are written by Spark's own writer, one record a file, so they lie
wherever Spark can write and a task that is lost or run twice leaves one copy.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .storage import Scratch, read_file, small_batches, write_file

MAGIC = b"LTK2"
HEAD = struct.Struct("<4sB16sIIQI")
ENTRY = np.dtype([("id", "<i8"), ("tokens", "<u4"), ("end", "<u4")])
SHARD_BYTES = 4 << 20
NO_ID = -(1 << 63)
INDEX = "path string, part long, seq long, first long, tokens long, docs long, first_id long, last_id long"


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary; where the samples are too few to train one, their own bytes."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def place(image: bytes) -> tuple[int, int]:
    """Partition of a shard, and tokens before it there."""
    _, _, _, part, _, first, _ = HEAD.unpack_from(image)
    return part, first


class Shard:
    """Writes and reads one image."""

    LEVEL = 3

    def __init__(self, dictionary: bytes, width: int):
        self.hash, self.width = dictionary_hash(dictionary), width
        d = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
        if d is not None:
            d.precompute_compress(level=self.LEVEL)
        self.c, self.d = zstandard.ZstdCompressor(level=self.LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)

    def write(self, docs: list[tuple[int, np.ndarray]], part: int = 0, seq: int = 0, first: int = 0) -> bytes:
        """docs: id and ids of width bytes each."""
        frames = [self.c.compress(np.ascontiguousarray(ids, f"<u{self.width}").data.cast("B") if len(ids) else b"") for _, ids in docs]
        index = np.zeros(len(docs), ENTRY)
        index["id"], index["tokens"], index["end"] = [i for i, _ in docs], [len(x) for _, x in docs], np.cumsum([len(f) for f in frames])
        return HEAD.pack(MAGIC, self.width, self.hash, part, seq, first, len(docs)) + index.tobytes() + b"".join(frames)

    def index(self, image: bytes) -> np.ndarray:
        magic, width, key, _, _, _, n = HEAD.unpack_from(image)
        if magic != MAGIC or width != self.width or key != self.hash:
            raise ValueError("not a shard of this dictionary")
        return np.frombuffer(image, ENTRY, n, HEAD.size)

    def read(self, image: bytes, k: int, index: np.ndarray | None = None) -> np.ndarray:
        """Ids of the k-th document of the image, reading its frame only."""
        index = self.index(image) if index is None else index
        base = HEAD.size + index.nbytes
        a = int(index["end"][k - 1]) if k else 0
        raw = self.d.decompress(image[base + a : base + int(index["end"][k])], max_output_size=int(index["tokens"][k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def _write(path: str, end_id: int | None, dictionary, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = bpe.encoder(path, "library")
        shard, part, seq, held, size, start = Shard(dictionary.value, width), TaskContext.get().partitionId(), 0, [], 0, 0
        image = lambda: pa.RecordBatch.from_arrays([pa.array([shard.write(held, part, seq, start)], pa.binary())], ["image"])
        for batch in batches:
            names, row = batch.column(0).fill_null(NO_ID).to_numpy(), 0
            for rows in bpe.texts(batch.column(1)):
                ids, counts = encode(rows)
                ends = np.cumsum(counts)
                ids = ids.astype(f"<u{width}")
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                at = 0
                for end in ends.tolist():
                    held.append((int(names[row]), ids[at:end]))
                    size, at, row = size + (end - at) * width, end, row + 1
                    if size >= SHARD_BYTES:
                        yield image()
                        start, seq, held, size = start + size // width, seq + 1, [], 0
        if held:
            yield image()

    return run


def _sample(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = bpe.encoder(path, "library")
        width = 2 if len(names) <= 1 << 16 else 4
        for batch in batches:
            for rows in bpe.texts(batch.column(0)):
                ids, counts = encode(rows)
                parts = [x[: (16 << 10) // width].astype(f"<u{width}").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([width] * len(parts), pa.int32())], ["sample", "width"])

    return run


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = image.as_buffer()
            _, _, _, part, seq, first, n = HEAD.unpack_from(image)
            index = np.frombuffer(image, ENTRY, n, HEAD.size)
            rows.append((path, part, seq, first, int(index["tokens"].sum(dtype=np.int64)), n, int(index["id"][0]), int(index["id"][-1])))
        if rows:
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))


def _shards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int | None = None, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1500) -> str:
    """Encode docs and write token files in ascending order of id_col below the folder root, which is returned.

    path: the tokenizer's file; root: a folder that all executors can write
    (left out: a new one in the shared folder). The dictionary is trained on
    the ids of at most sample_docs texts, those whose ids have the smallest
    hashes, of which the first 16 KB of ids count. end_id, if given, is
    appended to each text. A null text counts as empty; rows with a null id
    come first; rows that repeat an id are ordered by their text. Other columns
    are not read. An empty table gives a folder without shards.
    """
    root = (root or f"{Scratch(spark, 'token-files').root}/files").rstrip("/")
    d = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = [r.id for r in d.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample_docs).collect()]
    one = d.where(F.col("id").isin(chosen)).groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = one.select("text").mapInArrow(_sample(path), "sample binary, width int").collect() if chosen else []
    width = got[0].width if got else 4
    dictionary = train_dictionary([bytes(r.sample) for r in sorted(got, key=lambda r: bytes(r.sample))])
    name = f"{dictionary_hash(dictionary).hex()}.dict"
    write_file(spark, f"{root}/{name}", dictionary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = d.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    images = ordered.mapInArrow(_write(path, end_id, spark.sparkContext.broadcast(dictionary), width), "image binary")
    # The bytes go to the files as they are, with a newline after them.
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{root}/shards")
    _shards(spark, f"{root}/shards").mapInArrow(_headers, INDEX).write.parquet(f"{root}/index")
    write_file(spark, f"{root}/manifest.json", json.dumps({"width": width, "end_id": end_id, "dictionary": name}).encode())
    return root


def _read(dictionary, width: int, before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, starts = Shard(dictionary.value, width), before.value
        for batch in batches:
            for scalar in batch.column(1):
                image = scalar.as_py()
                index = shard.index(image)
                part, first = place(image)
                n = index["tokens"].astype(np.int64)
                start = starts[part] + first + np.cumsum(n) - n
                names = pa.array(index["id"], pa.int64(), mask=index["id"] == NO_ID)
                for lo in range(0, len(index), 256):
                    ids = [shard.read(image, k, index).astype("<u4").tobytes() for k in range(lo, min(lo + 256, len(index)))]
                    yield pa.RecordBatch.from_arrays([names[lo : lo + 256], pa.array(start[lo : lo + 256]), pa.array(n[lo : lo + 256]), pa.array(ids, pa.binary())], ["id", "start", "n_tokens", "ids"])

    return run


def _opened(spark: SparkSession, root: str) -> tuple[dict, bytes]:
    manifest = json.loads(read_file(spark, f"{root}/manifest.json"))
    dictionary = read_file(spark, f"{root}/{manifest['dictionary']}")
    if f"{dictionary_hash(dictionary).hex()}.dict" != manifest["dictionary"]:
        raise ValueError("the dictionary's bytes don't fit its name")
    return manifest, dictionary


def read_token_files(spark: SparkSession, root: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of every document below root; ids as little-endian unsigned 32-bit integers.

    start counts the ids of all documents before it. What reaches the driver
    is the dictionary and one sum for each partition of the shards.
    """
    manifest, dictionary = _opened(spark, root)
    sums = {r.part: r.n for r in spark.read.schema(INDEX).parquet(f"{root}/index").groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    schema = "id long, start long, n_tokens long, ids binary"
    if not sums:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    b = spark.sparkContext.broadcast
    return _shards(spark, f"{root}/shards").mapInArrow(_read(b(dictionary), manifest["width"], b(before)), schema).withColumnRenamed("id", id_col)


def read_document(spark: SparkSession, root: str, doc_id: int) -> list[np.ndarray]:
    """Ids of each row with this id, in the files' order: the index names its shards, and only its frames are decompressed."""
    manifest, dictionary = _opened(spark, root)
    shard, out = Shard(dictionary, manifest["width"]), []
    found = spark.read.schema(INDEX).parquet(f"{root}/index").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for r in found.orderBy("part", "seq").collect():
        image = bytes(_shards(spark, r.path).first().content)
        index = shard.index(image)
        out += [shard.read(image, int(k), index) for k in np.flatnonzero(index["id"] == doc_id)]
    return out
