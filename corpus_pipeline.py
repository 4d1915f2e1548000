"""A corpus pipeline of five stages over the documents table.

Each stage takes what its predecessor kept and returns the columns of
documents; the last returns the token ids and their decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id
from lodestone.llm.bpe import default_vocabulary
from lodestone.llm.bpe_codec import bpe_codec
from lodestone.llm.decontaminate import leaks
from lodestone.llm.line_dedup import info_name, line_dedup
from lodestone.llm.ngram_jaccard import ngram_jaccard
from lodestone.llm.storage import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognisable language (null text, or no letter) go, each by its own text.

    Null and repeated ids play no part. Where no row has a language to learn
    from, the network knows none and every row goes.
    """
    return language_id.recognised(spark, docs, language_id.train(spark, docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line passages are cut out; a document of nothing else goes. n_chars follows the text.

    Rows without an id and null texts stay as they are. Rows that share an id
    are documents of their own, each cleaned by its own text; identical rows
    are one document and are cut alike.
    """
    out = line_dedup(spark, docs, size=3)
    removed = F.col(info_name(docs.columns))["n_removed"]
    left = out.where((removed == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (left if n_chars is None else left.withColumn("n_chars", n_chars)).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows without an id are no one's copy and stay. Rows that share an id are one
    document here and stay or go together.
    """
    found = ngram_jaccard(spark, docs, n=5, num=80, den=100)
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, as it is or with other values, go, each by its own id and text.

    Rows with a null or repeated id are judged like others; null texts stay;
    an empty benchmark takes nothing.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    return rows.join(leaks(spark, rows, bench, id_col="_row").select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and the text they decode to, for every row; a null text has none."""
    return bpe_codec(docs, default_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontaminate", decontamination_stage),
    ("bpe", bpe_stage),
]
# A trained network and byte-pair encoding have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
