"""run() of the pipeline against a plain version of its five stages."""

import itertools
import re
import struct

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe

DATA = "/root/testdata/sf0.001"


def plain(docs, bench):
    docs = {i: t for i, t in docs if t and any(c.isalpha() for c in t)}
    first, cut = {}, {}
    for i in sorted(docs):
        rows = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(docs[i].split("\n"))]
        rows = [r for r in rows if r[1]]
        for p in range(len(rows) - 2):
            f = first.setdefault(tuple(r[1] for r in rows[p : p + 3]), (i, p))
            if f != (i, p):
                cut.setdefault(i, set()).update(rows[q][0] for q in range(p, p + 3) if f[0] != i or q >= f[1] + 3)
    cleaned = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut.get(i, ())) for i, t in docs.items()}
    docs = {i: t for i, t in cleaned.items() if not cut.get(i) or t.strip()}
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x) and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    docs = {i: t for i, t in docs.items() if root[i] == i}
    flat = lambda t: " " + re.sub(r"\W+", " ", t).lower().strip() + " "
    return {i: t for i, t in docs.items() if not any(flat(b) in flat(t) for b in bench)}


def test_pipeline(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = plain(docs, bench)
    lib = bpe.library(bpe.default_vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[i].decoded == lib.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("sig", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, DATA)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = out


def test_stages_with_null_and_repeated_ids(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    copy = " ".join(f"copy{chr(97 + i % 26)}" for i in range(40))
    alone = " ".join(f"alone{chr(97 + i % 26)}" for i in range(40))
    rows = [(None, copy), (None, item), (None, None), (None, "12 34"), (1, copy), (2, copy), (3, alone), (3, None), (3, item), (4, "99")] + [(100 + i, f"some plain words of document {chr(97 + i)}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, k long")
    left = lambda df: {r.k for r in df.collect() if r.k < 10}
    assert left(corpus_pipeline.language_stage(spark, docs, DATA)) == {0, 1, 4, 5, 6, 8}
    assert left(corpus_pipeline.jaccard_stage(spark, docs.where("k not in (2, 3, 7, 9)"), DATA)) == {0, 1, 4, 6, 8}
    assert left(corpus_pipeline.decontamination_stage(spark, docs, DATA)) == {0, 2, 3, 4, 5, 6, 7, 9}


def test_stages_with_empty_tables_and_ties(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, line_dedup int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert sorted(out.columns) == sorted(docs.columns) and out.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() == 0
    # Of equal texts the smallest id stays; identical rows stay or go together.
    text = " ".join(f"word{i}" for i in range(30))
    tied = spark.createDataFrame([(9, text, 1), (4, text, 2), (4, text, 3), (7, text, 4)], "doc_id long, text string, k long")
    assert sorted(r.k for r in corpus_pipeline.jaccard_stage(spark, tied, DATA).collect()) == [2, 3]
    lines = spark.createDataFrame([(None, "a\nb\nc", 1), (1, "a\nb\nc", 2), (2, "a\nb\nc\nd e f", 3), (2, None, 4), (3, "a\nb\nc", 5)], "doc_id long, text string, line_dedup long")
    assert sorted((r.line_dedup, r.text) for r in corpus_pipeline.line_stage(spark, lines, DATA).collect() if r.text) == [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "d e f")]


def test_jaccard_stage_loses_no_pair_at_the_threshold(spark):
    """Each second text is the first with a quarter more 5-word shingles; random choices of parts had left these pairs out."""
    rows = []
    for seed, short, long in [(8058, 8, 9), (11448, 8, 9), (17877, 8, 9), (20256, 8, 9), (16578, 20, 24), (26143, 20, 24)]:
        words = [f"w{seed}x{i}" for i in range(long)]
        rows += [(2 * seed, " ".join(words[:short])), (2 * seed + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, DATA).collect()) == sorted(i for i, _ in rows[::2])
