"""Files from folders, archives and listings of version control services, and their history."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T

FILES = "file_path string, content string"


def globs(x: str) -> list[str]:
    return [g.strip() for g in x.split(";") if g.strip()]


def listed(files: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Files whose path the settings' globs take."""
    return files.where(T.glob_match(F.col("file_path"), globs(cfg.include), globs(cfg.exclude)))


def file_id(path: Column) -> Column:
    """A number that depends on the path alone, so a rebuilt index keeps its ids and no task numbers all rows."""
    return F.xxhash64(path)


def text_of(content: Column) -> Column:
    """UTF-8 text of bytes without a byte order mark; null where they are no UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", "")


def local_files(spark: SparkSession, root: str, cfg: Settings = Settings()) -> DataFrame:
    """(file_path, content) below root. Globs meet the path before any file is opened."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    at = F.instr("path", base)  # the scan's paths carry the scheme
    path = F.when(at > 0, F.substring(F.col("path"), at + F.length(F.lit(base)), F.lit(1 << 30))).otherwise(F.col("path"))
    return listed(x.withColumn("file_path", path), cfg).select("file_path", text_of(F.col("content")).alias("content"))


def inside(name: str) -> str | None:
    """The entry's path below the target folder, or None where it would leave it."""
    n = name.replace("\\", "/")
    if n.startswith("/") or ":" in n.split("/")[0]:
        return None
    p = posixpath.normpath(n)
    return None if p == ".." or p.startswith("../") else p


def entries(raw: bytes) -> Iterator[tuple[str, str | None]]:
    """(path, text) of an archive's files; a single top folder is taken off; text is None where it is no UTF-8."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
        bad = [n for n in names if inside(n) is None]
        if bad:
            raise ValueError(f"an archive entry lies outside its folder: {bad[0]}")
        tops = {inside(n).split("/")[0] for n in names}
        strip = len(tops) == 1 and all("/" in inside(n) for n in names)
        for n in names:
            p = inside(n)
            try:
                text = z.read(n).decode("utf-8-sig")
            except UnicodeDecodeError:
                text = None
            yield (p.split("/", 1)[1] if strip else p), text


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        for raw in x["content"]:
            for path, text in entries(raw):
                yield pd.DataFrame({"file_path": [path], "content": [text]})


def archive_files(spark: SparkSession, path: str, cfg: Settings = Settings()) -> DataFrame:
    """(file_path, content) of zip archives; a single top folder is taken off; an entry that leaves its folder fails the read."""
    x = spark.read.format("binaryFile").load(path).select("content")
    return listed(x.mapInPandas(_entries, FILES), cfg)


def listing(pages: DataFrame, kind: str, root: str = "") -> DataFrame:
    """pages (json) of a recursive listing -> (file_path): folders left out, paths relative to root.

    kind "versions" marks folders by isFolder; "blobs" keeps type blob, or no
    type and no folder. A broken page has no rows.
    """
    item = "struct<path: string, isFolder: boolean, gitObjectType: string>"
    x = pages.select(F.explode(F.from_json("json", f"struct<value: array<{item}>>")["value"]).alias("i")).select("i.*")
    folder = F.coalesce("isFolder", F.lit(False))
    type_ = F.lower(F.coalesce("gitObjectType", F.lit("")))
    keep = ~folder if kind == "versions" else (type_ == "blob") | ((type_ == "") & ~folder)
    return x.where(keep & F.col("path").isNotNull()).select(relative(F.col("path"), root).alias("file_path"))


def relative(path: Column, root: str) -> Column:
    """The path without root (in any case) and without leading slashes, slashes forward."""
    p = F.translate(path, "\\", "/")
    return F.regexp_replace(F.when(F.lower(p).startswith(root.lower()), F.substring(p, len(root) + 1, 1 << 30)).otherwise(p), "^/+", "")


def rooted(path: Column, root: str) -> Column:
    """The path below root; one that lies there already stays."""
    base = root.rstrip("/") + "/"
    return F.when(F.lower(path).startswith(base.lower()), path).otherwise(F.concat(F.lit(base), F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")))


def history(changes: DataFrame, first: bool) -> DataFrame:
    """changes (file_path, author, ts, change_id) -> (file_path, author, day): the oldest change, or the newest.

    Partial aggregates by path; equal times go by change_id.
    """
    pick = F.min if first else F.max
    x = changes.groupBy("file_path").agg(pick(F.struct("ts", "change_id", "author")).alias("c"))
    return x.select("file_path", T.author(F.col("c.author")).alias("author"), F.date_format("c.ts", "yyyy-MM-dd").alias("day"))


def contents(files: DataFrame, read: Callable[[str], str | None]) -> DataFrame:
    """(file_path, content) by a reader that runs in the tasks, once for each distinct path; a failed read is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for p in x["file_path"]:
                try:
                    out.append(read(p))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"file_path": x["file_path"], "content": out})

    return files.select("file_path").distinct().mapInPandas(run, FILES)


def capped(files: DataFrame, most: int, local_model: bool) -> DataFrame:
    """The first files by path that a hosted embedder is asked for; a local one takes all."""
    return files if local_model else files.orderBy("file_path").limit(most)


def newest_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last stays."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
