"""Versioned tables: staged, guarded, and switched by one manifest."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new one only where none is set and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stamps(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, size, time) of a table's files, or of the file itself."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))


class Store:
    """Tables below a folder; ``manifest`` names the live version, so a switch is one atomic rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def stage(self, tables: dict[str, DataFrame]) -> str:
        return self.add(uuid.uuid4().hex, tables)

    def add(self, version: str, tables: dict[str, DataFrame]) -> str:
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        return version

    def complete(self, version: str, table: str, listed: int, ratio: float = 0.95) -> bool:
        """Whether at least ratio of the listed files are staged (the bound is rounded down)."""
        return self.spark.read.parquet(f"{self.root}/{version}/{table}").count() >= int(listed * ratio)

    def promote(self, version: str, **facts: str) -> None:
        fs, path = self._fs()
        new, live = path(f"{self.root}/manifest.{version}"), path(f"{self.root}/manifest.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"version": version} | facts).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(new, live, options)

    def manifest(self) -> dict:
        rows = self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest()['version']}/{table}")

    def indexes(self, version: str) -> str:
        """Where a version's search indexes lie, beside its tables."""
        return f"{self.root}/{version}.indexes"

    def indexed(self) -> str | None:
        """The live version's indexes, or None where it has none."""
        fs, path = self._fs()
        at = self.indexes(self.manifest()["version"])
        return at if fs.exists(path(at)) else None

    def exists(self, table: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.root}/manifest.json")) and fs.exists(path(f"{self.root}/{self.manifest()['version']}/{table}"))

    def count(self, table: str) -> int:
        """Rows of the live table; 0 where it is missing."""
        return self.read(table).count() if self.exists(table) else 0

    def has_content(self, *tables: str) -> bool:
        return any(self.exists(t) and not self.read(t).isEmpty() for t in tables)

    def create_if_missing(self, schemas: dict[str, str]) -> None:
        """Empty tables where the live version lacks any; never drops rows."""
        if not all(self.exists(t) for t in schemas):
            self.promote(self.stage({t: self.read(t) if self.exists(t) else self.spark.createDataFrame([], s) for t, s in schemas.items()}))

    def reset(self) -> None:
        """A live version with the same tables, all empty."""
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/{self.manifest()['version']}")) if s.isDirectory()]
        self.promote(self.stage({t: self.read(t).limit(0) for t in names}))


def replaced(live: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """live with the rows of the same key exchanged for the given ones."""
    return live.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def cascaded(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")
