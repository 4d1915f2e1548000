"""Expectations of the gate, globs, repository addresses, settings, grounding and the store."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as T
from lodestone.operators.hybrid import relevance_gate
from lodestone.sources.store import Store

# A tenth of the best score is the floor, at any scale; a best score under a millionth keeps nothing.
GATE = [
    ([0.8, 0.4, 0.3, 0.07], 3), ([0.008, 0.004, 0.003, 0.0007], 3), ([8e-5, 4e-5, 3e-5, 7e-6], 3), ([0.0] * 4, 0), ([9e-7, 5e-7], 0),
    ([0.002, 0.00019, 0.0001, 0.0], 1), ([0.5, 0.4, 0.3, 0.2, 0.06], 5), ([0.97, 0.33, 0.15, 0.09, 0.001], 3), ([0.5, 0.05], 2),
]


@pytest.mark.parametrize("scores,kept", GATE)
def test_gate_by_ratio(spark, scores, kept):
    df = spark.createDataFrame([(1, i, s, None) for i, s in enumerate(scores)], "query_id long, position long, rerank_score double, lexical boolean")
    assert relevance_gate(df).count() == kept


def test_gate_vector_only(spark):
    df = spark.createDataFrame([(1, 0, 0.02, False), (1, 1, 0.01, True), (1, 2, 0.004, False)], "query_id long, position long, rerank_score double, lexical boolean")
    assert [r.position for r in relevance_gate(df).collect()] == [1]
    assert relevance_gate(df, Settings(min_vector_only_score=0.0)).count() == 3


@pytest.mark.parametrize("path,ok", [("src/App/Foo.cs", True), ("Foo.cs", True), ("src/bin/Debug/Foo.cs", False), ("README.md", False), ("src/obj/x.cs", False), ("src\\App\\Foo.cs", True), ("src\\bin\\Debug\\Foo.cs", False), ("bin/Generated.cs", False)])
def test_globs(spark, path, ok):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(T.glob_match(F.col("p"), ["**/*.cs"], ["**/bin/**", "**/obj/**"])).first()[0] is ok
    assert df.select(T.glob_match(F.col("p"), [], ["**/bin/**"])).first()[0] is ("bin" not in path)


@pytest.mark.parametrize("url", ["https://host.example/own/rep", "http://host.example/own/rep", "own/rep", "https://host.example/own/rep.git", "own/rep.GIT", "git@host.example:own/rep.git", "https://host.example/own/rep/"])
def test_repository_addresses(spark, url):
    assert tuple(spark.createDataFrame([(url,)], "u string").select(T.repo_parts(F.col("u"))).first()[0]) == ("own", "rep")


def test_no_repository(spark):
    got = spark.createDataFrame([("",), (None,), ("  ",)], "u string").select(T.repo_parts(F.col("u")).alias("r")).collect()
    assert all(tuple(r.r) == ("", "") for r in got)


def test_grounding(spark):
    got = spark.createDataFrame([("",), (None,), (" \n\t ",), ("\r\n\r\n",), ("class A {}",)], "c string").select(T.grounded(F.col("c")).alias("g")).collect()
    assert [r.g for r in got] == [False, False, False, False, True]


def test_settings(tmp_path):
    s = Settings()
    for bad in ("0", "-0.5", "2.5", "x"):
        assert s.merged({"max_distance": bad}).max_distance == 1.0
    for good in ("1.0", "0.75", "2"):
        assert s.merged({"max_distance": good}).max_distance == float(good)
    for bad in ("-0.1", "1.5"):
        assert s.merged({"min_score_ratio": bad}) == s
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"n_results": "7", "unknown": 1}))
    assert Settings.load(str(tmp_path / "none.json"), str(f)).n_results == 7


def test_store_guard_and_switch(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a = store.stage({"files": spark.range(94)})
    assert not store.complete(a, "files", 100)
    b = store.stage({"files": spark.range(95)})
    assert store.complete(b, "files", 100)
    store.promote(b, model="m")
    assert store.read("files").count() == 95 and store.manifest()["model"] == "m"
    c = store.stage({"files": spark.range(3)})
    assert store.read("files").count() == 95
    store.promote(c)
    assert store.read("files").count() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("203.0.113.9:443, 10.0.0.1", "Ann <a@b>", "x" * 501, "aaa b")], "ip string, a string, k string, q string")
    r = df.select(T.client_ip(F.col("ip")).alias("ip"), T.author(F.col("a")).alias("a"), T.cap_key(F.col("k")).alias("k"), T.first_upper(F.col("q")).alias("u")).first()
    assert r.ip == "203.0.113.9" and r.a == "Ann" and len(r.k) == 500 and r.k[491] == "#" and r.u == "Aaa b"


def test_stored_index_equals_plans_over_the_table(spark, tmp_path, monkeypatch):
    from lodestone.operators import fulltext

    docs = spark.createDataFrame([(i, f"word{i % 7} {'common ' * (i % 3)} tail{i}", None if i % 5 else "extra Title") for i in range(60)] + [(100, None, None), (101, "", "")], "id long, body string, title string")
    asked = spark.createDataFrame([(1, "common word3"), (2, "TITLE tail12"), (3, "nothing here"), (4, ""), (5, "'tail5' & \"tail6\"")], "query_id long, text string")
    plain = fulltext.TextIndex.over(docs, "id", ["body", "title"])
    plain.write(str(tmp_path / "i"))
    stored = fulltext.TextIndex.open(spark, str(tmp_path / "i"))
    got = [sorted(map(tuple, fulltext.bm25(x, asked).collect())) for x in (plain, stored)]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {1, 2, 5}
    monkeypatch.setattr(fulltext, "MOST_TERMS", 2)
    assert sorted(map(tuple, fulltext.bm25(stored, asked).collect())) == got[0]
    plan = fulltext.TextIndex.open(spark, str(tmp_path / "i"))
    monkeypatch.undo()
    text = plan.matching(asked.select(F.explode(T.tokens(F.col("text"))).alias("term")))[0]._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in text or "PartitionFilters: [isnotnull(bucket" in text and "PushedFilters: [In(term" in text


def test_an_index_is_stored_in_blocks(spark, tmp_path, monkeypatch):
    """Postings of a task are put together by term before they are shuffled; blocks of few words change nothing."""
    from lodestone.operators import fulltext

    docs = spark.range(400, numPartitions=4).select(F.col("id"), F.concat(F.lit("Every line "), F.col("id") % 3, F.lit(" every "), F.col("id")).alias("body"))
    docs = docs.union(spark.createDataFrame([(-7, None), (2**62, "line LINE")], "id long, body string"))
    plain = fulltext.TextIndex.over(docs, "id", ["body"])
    want = sorted(map(tuple, plain.postings.collect()))
    for words, blocks in ((2_000_000, 16), (40, 1000)):
        monkeypatch.setattr(fulltext, "WORDS", words)
        plain.write(str(tmp_path / str(words)))
        stored = fulltext.TextIndex.open(spark, str(tmp_path / str(words)))
        assert sorted(map(tuple, stored.postings.collect())) == want
        assert sorted(map(tuple, stored.terms.collect())) == sorted(map(tuple, plain.terms.collect()))
        assert stored.stats.collect() == plain.stats.collect()
        assert spark.read.parquet(str(tmp_path / str(words) / "postings")).where("term = 'line'").count() <= blocks
    empty = fulltext.TextIndex.over(docs.limit(0), "id", ["body"])
    empty.write(str(tmp_path / "empty"))
    none = fulltext.TextIndex.open(spark, str(tmp_path / "empty"))
    assert none.postings.count() == none.terms.count() == 0 and [tuple(r) for r in none.stats.collect()] == [(0, None)]


def test_hits_of_one_rank_are_numbered_by_many_tasks(spark):
    from lodestone.operators import fulltext

    ids = [*range(0, 6000, 2), -(2**62), 2**62, -1]
    hits = spark.createDataFrame([(q, i, 40 + (i % 20 == 0)) for q in (1, 2) for i in ids if q == 1 or -5 < i < 999] + [(3, 5, 50), (3, 6, 9)], "query_id long, id long, rank int")
    got = sorted(map(tuple, fulltext.ranked(hits, 10).collect()))
    want = []
    for q in (1, 2, 3):
        mine = sorted((-r.rank, r.id) for r in hits.where(f"query_id = {q} and rank >= 10").collect())
        want += [(q, i, -r, p) for p, (r, i) in enumerate(mine, 1)]
    assert got == sorted(want)
    even = spark.range(64_000).select((F.col("id") % 1).alias("query_id"), "id", (F.col("id") % 1 + 7).cast("int").alias("rank"))
    plan = fulltext.ranked(even, 1)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\(([^)]*?), \d+\)", plan))
    assert dealt and all(re.fullmatch(r"query_id#\d+L?, rank#\d+, part#\d+|query_id#\d+L?", x) for x in dealt)


def test_vectors_of_their_own_meet_only_the_vector_leg(spark):
    from lodestone.operators.hybrid import hybrid_search

    files = spark.createDataFrame([(i, f"f{i}.cs", "one two") for i in range(4)], "file_id long, file_path string, content string")
    chunks = spark.createDataFrame([(10 * f + c, f, "line" if c else "head", f"one word{c}") for f in range(4) for c in range(3)], "chunk_id long, file_id long, chunk_type string, content string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in (0, 1, 11, 30, 99)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, "word1 two", [1.0, 0.5]), (2, "one", None)], "query_id long, text string, vector array<float>")
    joined = chunks.join(vectors, "chunk_id", "left")
    for kind in (None, "head"):
        want = sorted(map(tuple, hybrid_search(spark, asked, files, joined, 7, chunk_type=kind).collect()))
        got = hybrid_search(spark, asked, files, chunks, 7, chunk_type=kind, vectors=vectors)
        assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == {1, 2} and any(r[8] is not None for r in want)


def test_vectors_of_another_length_are_refused(spark):
    from lodestone.operators import vectors

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.5])], "query_id long, vector array<float>")
    assert vectors.vector_topk(spark, v.where("vec_id <> 2"), q).count() == 1
    for bad in (lambda: vectors.vector_topk(spark, v, q).count(), lambda: v.select(T.of_dimension(F.col("embedding"), 2)).collect(), lambda: v.crossJoin(q).select(vectors.cosine_similarity(F.col("embedding"), F.col("vector"))).collect()):
        with pytest.raises(Exception, match="components|two lengths"):
            bad()
    assert [r[0] for r in v.where("vec_id <> 2").orderBy("vec_id").select(T.of_dimension(F.col("embedding"), 2)).collect()] == [[1.0, 0.0], None]


def test_search_by_cells_finds_nine_in_ten(spark, tmp_path):
    import numpy as np

    from lodestone.operators import vectors

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 24))
    x = np.repeat(middle, 50, axis=0) + 0.5 * rng.normal(size=(2000, 24))
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(5000, [0.0] * 24), (5001, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vectors.VectorIndex.build(spark, df, str(tmp_path / "v"), cells=32)
    assert index.cells.count() == len(rows)
    found = 0
    for lo in range(0, 2000, 200):
        q = df.where(f"vec_id = {lo}").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        near = {r.id for r in index.search(spark, q, 20, 2.0, probes=8).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        found += len(near & set(np.argsort(-(u @ u[lo]), kind="stable")[:20].tolist()))
    assert found >= 0.9 * 200
    q = df.where("vec_id in (3, 700)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = sorted(map(tuple, vectors.vector_topk(spark, df, q, 10).collect()))
    assert sorted(map(tuple, index.search(spark, q, 10, probes=32).collect())) == exact
    empty = vectors.VectorIndex.build(spark, df.limit(0), str(tmp_path / "e"))
    assert empty.search(spark, q).count() == 0


def test_answers_of_services(spark):
    rows = [("[1, 2]",), ("[[1, 2]]",), ('{"vector": [1, 2]}',)]
    df = spark.createDataFrame(rows, "b string")
    assert all(r[0] == [1.0, 2.0] for r in df.select(T.vector_of(F.col("b"), 2)).collect())
    for bad in ('{"error": "x"}', "[1, 2, 3]", "oops", None):
        with pytest.raises(Exception, match="no vector|components"):
            spark.createDataFrame([(bad,)], "b string").select(T.vector_of(F.col("b"), 2)).collect()
    df = spark.createDataFrame([(37,), (138,), (3852,), (0,)], "s long")
    assert [r[0] for r in df.select(T.elapsed(F.col("s"))).collect()] == ["37s", "2m 18s", "1h 04m 12s", "0s"]
    df = spark.createDataFrame([(["a.cs", "", None, "b.cs"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(T.source_list(F.col("p"))).collect()] == ["\n\nSources:\n- a.cs\n- b.cs", "", ""]
    assert "indexed codebase" in T.NO_GROUNDS and "retrieved" in T.NO_GROUNDS.lower()


def test_hosted_models(spark):
    import json as j

    from lodestone.models import hosted

    post = lambda url, payload, headers: j.dumps([[3.0, 4.0]]) if "inputs" in payload else j.dumps({"results": [{"index": i, "relevance_score": float(len(c))} for i, c in enumerate(payload["texts"])]})
    df = spark.createDataFrame([("q", "ab"), ("q", "abc"), (None, None), (" ", "x")], "a string, b string")
    got = df.select(hosted.hosted_embedder("u", 2, post=post)(F.col("a")), hosted.hosted_scorer("u", "texts", post=post)(F.col("a"), F.col("b"))).collect()
    assert [list(map(lambda x: round(x, 6), r[0])) for r in got] == [[0.6, 0.8], [0.6, 0.8], [0.0, 0.0], [0.0, 0.0]] and [r[1] for r in got] == [2.0, 3.0, 0.0, 1.0]

    def down(url, payload, headers):
        raise OSError("down")

    assert [r[0] for r in df.select(hosted.hosted_scorer("u", post=down)(F.col("a"), F.col("b"))).collect()] == [None] * 4
    assert hosted.scores_of("broken", 2) == [None, None] and hosted.scores_of('[{"index": 1, "score": 0.5}, {"index": 9}]', 2) == [None, 0.5]


def test_waking_services():
    import io
    import urllib.error

    from lodestone.sources import http

    waits, left = [], [503, 429, 409]

    def opener(request, timeout):
        if left:
            raise urllib.error.HTTPError("u", left.pop(0), "", {}, None)
        return io.BytesIO(b"ok")

    assert http.warm_post("http://u", {"a": 1}, opener=opener, sleep=waits.append) == "ok" and waits == [2.0, 4.0, 6.0]
    left[:] = [401]
    with pytest.raises(urllib.error.HTTPError):
        http.warm_post("http://u", {}, opener=opener, sleep=waits.append)
    assert http.default_branch('{"default_branch": "trunk"}') == "trunk" and http.default_branch("x") == http.default_branch("{}") == "main"
