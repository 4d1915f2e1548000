"""Lexical fallback: names, identifiers, assignments, fuzzy names, and the blend with full text."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..sources.store import shared_root
from .fulltext import TextIndex, bm25
from .hybrid import file_text


def literal_like(x: str) -> str:
    return x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def filename_search(files: DataFrame, name: str, n: int = 5, raw: bool = False) -> DataFrame:
    """Paths that contain name, in any case; raw leaves % and _ as wildcards."""
    return files.where(F.col("file_path").ilike(f"%{name if raw else literal_like(name)}%")).orderBy("file_path").limit(n)


def assigns_field(content: Column, field: str) -> Column:
    f, u = literal_like(field), literal_like(field[:1].upper() + field[1:])
    return content.ilike(f"%.{f} =%") | content.ilike(f"%.{u} =%") | content.ilike(f"%.{u}% =%")


def identifier_search(files: DataFrame, terms: list[str], columns: list[str], name: str, n: int) -> DataFrame:
    """Rows in which a term occurs in one of the columns; the shortest name first."""
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{literal_like(t)}%") for t in terms for c in columns])
    return files.where(hit).orderBy(F.length(F.rtrim(F.col(name))), "file_path").limit(n)


# Terms up to this number are broadcast to the names.
FEW_TERMS = 2_000
# Names of more letters than this meet many terms by pieces: the ways to leave out letters grow with a power of the length.
LONGEST = 40


def fuzzy_nearest(terms: DataFrame, names: DataFrame, most: int = 3, min_length: int = 8) -> DataFrame:
    """(term, name, edits) of the nearest name within most edits; ties by name.

    Terms that are names meet them by equality. The few others of a batch of
    questions go to every task and meet the names of near lengths there, since
    an edit changes a length by at most one. Of many, those at one edit are
    looked for first, then the rest at two, and so on, so a term that has a
    near name meets none of its farther ones.
    """
    spark, parts = terms.sparkSession, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # With a number, so that few bytes are still many tasks.
    n = names.where(F.length("name") >= min_length).select("name").repartition(parts, "name").distinct()
    t = terms.where(F.col("term").isNotNull()).select("term").distinct()
    same = t.join(n, t.term == n.name).select("term", "name", F.lit(0).alias("edits"))
    left = t.join(n, t.term == n.name, "left_anti")
    if left.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        return same.unionByName(_nearest(_by_length(left, n, most), most))
    root, found = f"{shared_root(spark)}/fuzzy-{uuid.uuid4().hex}", [same]
    stored = lambda df, part: (df.write.parquet(f"{root}/{part}"), spark.read.schema(df.schema).parquet(f"{root}/{part}"))[1]
    left, n = stored(left, "left0"), stored(n, "names")
    for k in range(1, most + 1):
        if k > 1 and left.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
            return reduce(DataFrame.unionByName, [*found, _nearest(_by_length(left, n, most), most)])
        pairs = _by_letters_left_out(left.repartition(parts, "term"), n.where(F.length("name") <= LONGEST).repartition(parts, "name"), k)
        pairs = pairs.unionByName(_by_pieces(left, n.where(F.length("name") > LONGEST), k))
        found.append(stored(_nearest(pairs, k), f"found{k}"))
        left = stored(left.join(found[-1], "term", "left_anti"), f"left{k}")
    return reduce(DataFrame.unionByName, found)


def _nearest(pairs: DataFrame, most: int) -> DataFrame:
    x = pairs.withColumn("edits", F.levenshtein("term", "name", most)).where("edits >= 0")
    x = x.groupBy("term").agg(F.min(F.struct("edits", "name")).alias("x"))
    return x.select("term", F.col("x.name").alias("name"), F.col("x.edits").alias("edits"))


def _by_length(t: DataFrame, n: DataFrame, most: int) -> DataFrame:
    t = t.withColumn("len", F.explode(F.sequence(F.length("term") - most, F.length("term") + most)))
    return n.withColumn("len", F.length("name")).join(F.broadcast(t), "len").select("term", "name")


def _by_letters_left_out(t: DataFrame, n: DataFrame, k: int) -> DataFrame:
    """Pairs among which are all at exactly k edits.

    Such a pair is one text once letters are left out of both, k of the longer
    one and k less the difference of the lengths of the other. So they meet by
    the hash of that text; how many names share one is bounded by the
    alphabet and their length, also where all begin alike.
    """

    def rest(df: DataFrame, name: str) -> DataFrame:
        x = df.select(name, F.col(name).alias("s"), F.lit(1).alias("from"), F.lit(0).alias("out"))
        parts = []
        for i in range(k + 1):
            parts.append(x.select(name, F.length(name).alias(f"{name}_len"), F.xxhash64("s").alias("hash"), "out"))
            if i < k:
                x = x.where(F.col("from") <= F.length("s")).withColumn("at", F.explode(F.sequence(F.col("from"), F.length("s"))))
                cut = F.concat(F.substring(F.col("s"), F.lit(1), F.col("at") - 1), F.substring(F.col("s"), F.col("at") + 1, F.length("s")))
                x = x.select(name, cut.alias("s"), F.col("at").alias("from"), F.lit(i + 1).alias("out"))
        return reduce(DataFrame.unionByName, parts)

    both = rest(t, "term").distinct().join(rest(n, "name").withColumnRenamed("out", "name_out").distinct(), "hash")
    longer = F.greatest("out", "name_out") == k
    return both.where(longer & (F.col("out") - F.col("name_out") == F.col("term_len") - F.col("name_len"))).select("term", "name")


def _by_pieces(t: DataFrame, n: DataFrame, most: int) -> DataFrame:
    """Pairs among which are all within most edits: a name cut in most + 1 pieces keeps one whole, moved by at most most places."""
    number = F.sequence(F.lit(0), F.lit(most))
    start = lambda i: F.floor(i * F.col("len") / (most + 1)).cast("int")
    size = start(F.col("i") + 1) - start(F.col("i"))
    n = n.withColumn("len", F.length("name")).withColumn("i", F.explode(number)).withColumn("piece", F.substring(F.col("name"), start(F.col("i")) + 1, size))
    t = t.withColumn("len", F.explode(F.sequence(F.length("term") - most, F.length("term") + most))).where(F.col("len") > LONGEST)
    t = t.withColumn("i", F.explode(number)).withColumn("at", F.explode(F.sequence(start(F.col("i")) - most, start(F.col("i")) + most))).where("at >= 0")
    t = t.withColumn("piece", F.substring(F.col("term"), F.col("at") + 1, size)).drop("at").distinct()
    return t.join(n, ["len", "i", "piece"]).select("term", "name").distinct()


def fts_score(rank: Column) -> Column:
    """Keyword hits min(100, rank / 10); a pattern hit has no rank and counts as 100."""
    near = F.greatest(F.lit(0e0), F.lit(20e0) - rank / 50)
    return F.when(rank.isNull(), 100e0).otherwise(F.greatest(F.lit(0e0), 100e0 - 5e0 * near))


def name_match(question: Column, path: Column, class_name: Column) -> Column:
    q, s, c = F.lower(question), F.lower(T.stem(path)), F.lower(class_name)
    bare = F.translate(q, " ", "")
    return ((s != "") & q.contains(s)) | F.coalesce((c != "") & q.contains(c), F.lit(False)) | ((bare != "") & s.contains(bare))


def blend(fts: DataFrame, by_name: DataFrame, question: str, n: int) -> DataFrame:
    """Full-text hits, then filename hits not among them, scored with the name boost, best first.

    Both sides: (file_path, class_name, rank). The order of equal scores is
    rank descending, then path.
    """
    both = fts.unionByName(by_name.join(fts.select("file_path"), "file_path", "left_anti"))
    score = fts_score(F.col("rank")) + F.when(name_match(F.lit(question), F.col("file_path"), F.col("class_name")), 200e0).otherwise(0e0)
    w = Window.orderBy(F.desc("score"), F.desc_nulls_last("rank"), "file_path")
    top = both.withColumn("score", score).orderBy(F.desc("score"), F.desc_nulls_last("rank"), "file_path").limit(n)
    return top.withColumn("pos", F.row_number().over(w))


def path_merge(fts: DataFrame, vectors: DataFrame, question: str, n: int) -> DataFrame:
    """(file_path, rank, vector_score, score): both sides by path, best first.

    fts (file_path, class_name, rank), vectors (file_path, vector_score), one
    row for each path. A hit of both gets its text score and 100 times the
    vector's; a vector's hit alone half of that and rank 999.
    """
    named = F.when(name_match(F.lit(question), F.col("file_path"), F.col("class_name")), 200e0).otherwise(0e0)
    text = fts.select("file_path", "rank", (fts_score(F.col("rank")) + named).alias("text_score"))
    both = text.join(vectors.select("file_path", "vector_score"), "file_path", "full")
    v = F.coalesce("vector_score", F.lit(0e0))
    score = F.when(F.col("text_score").isNull(), 50 * v).otherwise(F.col("text_score") + 100 * v)
    rank = F.when(F.col("text_score").isNull(), 999).otherwise(F.col("rank"))
    return both.select("file_path", rank.alias("rank"), v.alias("vector_score"), score.alias("score")).orderBy(F.desc("score"), "file_path").limit(n)


def asked_field(spark: SparkSession, question: str) -> str:
    """The field a question about filled or populated fields names; empty where it asks something else."""
    q = question.lower()
    if "field" not in q or not ("filled" in q or "populated" in q):
        return ""
    return spark.range(1).select(F.regexp_extract(F.lit(question), r"(?i)field\s+(\w+)", 1)).first()[0]


def corrected(terms: list[str], names: DataFrame, spark: SparkSession, cfg: Settings = Settings()) -> list[str]:
    """Each term as its nearest class name; a term without one stays as it is, in its place."""
    near = fuzzy_nearest(spark.createDataFrame([(t,) for t in terms], "term string"), names, cfg.fuzzy_edits, cfg.fuzzy_min_length)
    found = {r.term: r.name for r in near.collect()}  # at most one row for each term of a question
    return [found.get(t, t) for t in terms]


def fallback_search(spark: SparkSession, files: DataFrame, question: str, n: int, index: TextIndex | None = None) -> DataFrame:
    """(file_path, class_name, rank) without vectors; rank is null for pattern hits.

    files (file_id, file_path, class_name, base_class, method_names,
    property_names, content). A question for a field that is assigned
    somewhere gets those files; else one that names identifiers gets files
    with them, and where there are none, files with the nearest class names
    (tried once); else its keywords go to the full text.
    """
    pattern = lambda df: df.select("file_path", "class_name", F.lit(None).cast("int").alias("rank"))
    field = asked_field(spark, question)
    if field:
        hit = files.where(assigns_field(F.col("content"), field)).orderBy("file_path").limit(n)
        if not hit.isEmpty():
            return pattern(hit)
    words = spark.range(1).select(T.pascal_terms(F.lit(question)).alias("names"), T.keywords(F.lit(question)).alias("words")).first()
    if words.names:
        columns = ["class_name", "base_class", "method_names", "property_names"]
        hit = identifier_search(files, list(words.names), columns, "class_name", n)
        if hit.isEmpty():
            names = files.select(F.col("class_name").alias("name")).where(F.col("name") != "")
            hit = identifier_search(files, corrected(list(words.names), names, spark), columns, "class_name", n)
        return pattern(hit)
    asked = spark.createDataFrame([(0, " ".join(words.words))], "query_id long, text string")
    ranks = bm25(index or TextIndex.over(files, "file_id", file_text(files)), asked).where("rank > 0")
    top = ranks.orderBy(F.desc("rank"), "id").limit(n)
    return top.join(files.select(F.col("file_id").alias("id"), "file_path", "class_name"), "id").select("file_path", "class_name", "rank")


def fallback(spark: SparkSession, files: DataFrame, question: str, n: int = 5, index: TextIndex | None = None) -> DataFrame:
    """The blended fallback: over-fetched hits, files named like the question, name boosts, the best n."""
    hits = fallback_search(spark, files, question, max(4 * n, 20), index)
    named = files.limit(0) if len(question.strip()) < 2 else filename_search(files, question.strip(), n)
    return blend(hits, named.select("file_path", "class_name", F.lit(None).cast("int").alias("rank")), question, n)
