"""Intermediate tables in the folder that all executors share.

Spark's own lineage is cut by writing a table below ``spark.checkpoint.dir``
and reading it back, so a lost executor costs no recomputation of earlier
phases and no copy lives on one machine only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file from the driver, in any file system that Spark knows."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).first()
    return bytes(row.content) if row else b""  # the reader has no row for an empty file


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session's Arrow batches held to so many rows: texts can be long, and each task holds two batches."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return df


class Scratch:
    """Tables of one operator run; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and return the table read back (same schema, no lineage)."""
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_lodestone_path", None)
            if path:
                fs, p = _file(self.spark, path)
                fs.delete(p, True)
