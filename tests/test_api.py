"""Index builds, searches, fallback, rerank, sources, tokenizers and streams on small inputs."""

import datetime
import io
import json
import urllib.error
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.config import Settings
from lodestone.models import tokenizers as K
from lodestone.operators import lexical, rerank
from lodestone.sources import files as S
from lodestone.sources import http
from lodestone.sources.store import Store, cascaded, replaced
from lodestone.streaming import usage as U

A = "using System;\nnamespace Shop { public class BasketStore { public int Size { get; set; } public void AddItem(int price) { total.Amount = price; } public void Clear() { } } }"
B = "namespace Shop { public class OrderQueue : BasketStore { public void Enqueue(string order) { Console.WriteLine(\"queued order\"); } } }"
QUERIES = "query_id long, text string"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    for p, t in {"src/BasketStore.cs": A, "src/OrderQueue.cs": B, "bin/Skip.cs": A, "README.md": "no"}.items():
        f = d / p
        f.parent.mkdir(exist_ok=True)
        f.write_text(t)
    return str(d)


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("index")))
    embed = K.hashing_embedder(32)
    assert api.build_index(spark, S.local_files(spark, root), store, embed, "hash-32")
    with pytest.raises(ValueError):
        api.Engine.open(spark, store, embed, "other")
    return api.Engine.open(spark, store, embed, "hash-32", scorer=lambda q, c: F.when(F.lower(c).contains("enqueue"), 0.9).otherwise(0.01))


def test_local_files(spark, root):
    got = {r.file_path: r.content for r in S.local_files(spark, root).collect()}
    assert got == {"src/BasketStore.cs": A, "src/OrderQueue.cs": B}


def test_search_reranks_gates_and_shapes(spark, engine):
    q = spark.createDataFrame([(1, "enqueue an order"), (2, "queued order")], QUERIES)
    rows = engine.search(q).orderBy("query_id", "pos").collect()
    assert {r.query_id for r in rows} == {1, 2} and not any(r.degraded for r in rows)
    assert all("nqueue" in r.document for r in rows)
    m = rows[0].metadata
    assert set(rerank.SEARCH_KEYS) <= set(m) and m["rerank_score"] == "0.9" and m["_file_path"] == "src/OrderQueue.cs"


def test_batch_equals_single(spark, engine):
    plain = api.Engine(spark, engine.files, engine.chunks, engine.embedder)
    asked = [(1, "enqueue order"), (2, "clear basket"), (3, " ")]
    both = sorted((r.query_id, r.pos, r.id, r.document) for r in plain.search(spark.createDataFrame(asked, QUERIES)).collect())
    single = sorted((r.query_id, r.pos, r.id, r.document) for a in asked for r in plain.search(spark.createDataFrame([a], QUERIES)).collect())
    assert both == single and both


def test_chat_health_and_names(spark, engine):
    c = engine.chat(spark.createDataFrame([(1, "enqueue an order")], QUERIES)).first()
    assert c.grounded and c.context.startswith("// File: src/OrderQueue.cs\n") and c.sources == "src/OrderQueue.cs"
    h = engine.health().first()
    assert h.status == "Green" and h.healthy and h.files == 2
    assert engine.collections().first()["count"] == 2 and [(r.name, r.n) for r in engine.systems().collect()] == [("class", 2)]
    assert [r.id for r in engine.search_by_filename("basket").collect()] == ["src/BasketStore.cs"]


@pytest.mark.parametrize("question,want", [("which field Amount is filled", ["src/BasketStore.cs"]), ("where is OrderQueue", ["src/OrderQueue.cs"]), ("where is OrderQeueu", ["src/OrderQueue.cs"]), ("queued order", ["src/OrderQueue.cs"]), ("the a of", []), ("", [])])
def test_fallback(spark, engine, question, want):
    plain = api.Engine(spark, engine.files, engine.chunks)
    rows = plain.search(spark.createDataFrame([(7, question)], QUERIES)).collect()
    assert [r.id for r in rows] == want and all(r.degraded and r.query_id == 7 and set(rerank.FALLBACK_KEYS) == set(r.metadata) for r in rows)


def test_fuzzy_terms_keep_their_places(spark):
    names = spark.createDataFrame([("OrderQueue",), ("BasketStore",)], "name string")
    assert lexical.corrected(["Unrelated", "OrderQeueu"], names, spark) == ["Unrelated", "OrderQueue"]


def test_many_fuzzy_terms_by_pieces(spark, monkeypatch):
    import random

    rng = random.Random(1)
    names = ["".join(rng.choice("abcAB") for _ in range(rng.randint(8, 14))) for _ in range(150)]
    terms = []
    for x in names[:60]:
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "z" + x[i + 1 :]])
        terms.append(x)
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in [*terms, None, ""]], "term string")
    few = sorted(map(tuple, lexical.fuzzy_nearest(t, n).collect()))
    monkeypatch.setattr(lexical, "FEW_TERMS", 10)
    assert sorted(map(tuple, lexical.fuzzy_nearest(t, n).collect())) == few and len(few) > 40


def _joined(node) -> int:
    """Rows that the joins of an executed plan put out."""
    name, inner = node.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        inner = [node.executedPlan()]
    elif name.endswith("QueryStageExec"):
        inner = [node.plan()]
    else:
        inner = [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if "Join" in name and node.metrics().contains("numOutputRows") else 0
    return own + sum(map(_joined, inner))


def test_fuzzy_terms_that_are_names_meet_no_others(spark):
    """Names that begin alike share most of their pieces; that must not pair all with all."""
    x = spark.range(3000).select(F.format_string("Supplier#%09d", "id").alias("s"))
    near = lexical.fuzzy_nearest(x.select(F.col("s").alias("term")), x.select(F.col("s").alias("name")))
    got = near.collect()
    assert len(got) == 3000 and all(r.term == r.name and r.edits == 0 for r in got)
    assert _joined(near._jdf.queryExecution().executedPlan()) <= 3 * 3000


@pytest.mark.parametrize("longest", [40, 18, 0])
def test_many_fuzzy_terms_equal_all_pairs(spark, monkeypatch, longest):
    import random

    rng = random.Random(5)
    names = [f"Part#{i:06d}"[: 8 + i % 4] + "xyz"[: i % 3] for i in range(150)] + ["Warehouse" * 6 + str(i) for i in range(10)] + ["short"]
    terms = ["", "Part#"]
    for i in range(240):
        x = list(rng.choice(names))
        for _ in range(i % 5):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = [rng.choice("P0123q")] * rng.randrange(2)
        terms.append("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = _next(row, i, c, b)
        return row[-1]

    def _next(row, i, c, b):
        out = [i]
        for j, d in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
        return out

    want = {}
    for t in set(terms):
        near = min((distance(t, n), n) for n in names if len(n) >= 8)
        if near[0] <= 3:
            want[t] = near
    monkeypatch.setattr(lexical, "FEW_TERMS", 3)
    monkeypatch.setattr(lexical, "LONGEST", longest)
    got = lexical.fuzzy_nearest(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {r.term: (r.edits, r.name) for r in got} == want and len(got) == len(want)
    assert {k for k, _ in want.values()} == {0, 1, 2, 3}


def test_incomplete_build_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    embed = K.hashing_embedder(8)
    good = spark.createDataFrame([(f"f{i}.cs", f"class A{i} {{ }}") for i in range(20)], S.FILES)
    assert api.build_index(spark, good, store, embed, "m")
    bad = good.withColumn("content", F.when(F.col("file_path") < "f11", F.col("content")))
    assert not api.build_index(spark, bad, store, embed, "m")
    assert store.count("files") == 20 and store.count("none") == 0 and store.has_content("files") and not store.has_content("duplicates")
    store.create_if_missing({"files": "file_id long", "events": "id long"})
    assert store.count("files") == 20 and store.exists("events")
    store.reset()
    assert store.exists("files") and not store.has_content("files", "chunks")
    told = []
    assert api.build_index(spark, good, store, embed, "m", Settings(hosted_file_cap=5), local_model=False, on_cap=lambda *x: told.append(x))
    assert told == [(20, 5)] and store.count("files") == 5


def test_replace_and_cascade(spark):
    live = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    out = replaced(live, new, "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in cascaded(out, live.where("k = 1"), "k").collect()] == [1]


def test_rerank_scores_from_services(spark):
    body = spark.createDataFrame([(1, json.dumps({"results": [{"index": 1, "relevance_score": 0.9}, {"index": 99, "score": 1.0}, {"index": 0, "score": 0.5}]})), (2, json.dumps([{"index": 0, "score": 0.2}, {"index": 1}])), (3, "broken"), (4, json.dumps([{"index": 0, "score": 0.0}, {"index": 1, "score": 0.0}]))], "query_id long, json string")
    scores = rerank.parse_scores(body)
    assert sorted(map(tuple, scores.where("query_id = 2").collect())) == [(2, 0, 0.2), (2, 1, 0.0)]
    rows = spark.createDataFrame([(q, p, None) for q in (1, 2, 3, 4) for p in (0, 1)] + [(5, 0, None)], "query_id long, position long, lexical boolean")
    got = sorted((r.query_id, r.pos, r.position) for r in rerank.join_scores(rows, scores).collect())
    assert got == [(1, 1, 1), (1, 2, 0), (2, 1, 0), (3, 1, 0), (3, 2, 1), (5, 1, 0)]


def test_unanswered_scores_fall_back(spark):
    hits = spark.createDataFrame([(1, p, "q", f"d{p}", True) for p in (1, 2, 3)], "query_id long, pos int, question string, content string, lexical boolean")
    out = rerank.rerank(hits, lambda q, c: F.when(c == "d2", F.lit(0.4)), n_results=2).orderBy("pos").collect()
    assert [(r.position, r.rerank_score) for r in out] == [(0, 1.0), (1, 0.999)]


def test_lexical_support(spark):
    df = spark.createDataFrame([("Vector", "0", "0"), ("Vector", None, None), (None, None, None), ("Vector", "0", "0.0161"), ("Hybrid", "x", None)], "m string, c string, f string")
    assert [r[0] for r in df.select(rerank.lexical_support(F.col("m"), F.col("c"), F.col("f"))).collect()] == [False, False, True, True, False]


def test_word_pieces():
    v = {w: i for i, w in enumerate("[PAD] [UNK] [CLS] [SEP] play ##ing ##s a".split())}
    assert K.word_pieces("Playing a plays", v) == [2, 4, 5, 7, 4, 6, 3]
    assert K.word_pieces("playzz", v) == [2, 4, 1, 3] and K.word_pieces(None, v) == [2, 3]
    assert len(K.word_pieces("a " * 900, v)) == 512 and len(K.word_pieces("playing " * 900, v, 6)) == 6


def test_pairs_and_pooling(spark):
    assert K.pair([5, 6], [7, 8]) == [0, 5, 6, 2, 2, 7, 8, 2]
    assert len(K.pair([5] * 10, [7] * 900)) == 512 and K.pair([5] * 600, [7] * 9, 16) == [0] + [5] * 11 + [2, 2, 7, 2]
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)], "id long, v array<float>, mask int")
    assert [(r.id, r.pooled) for r in K.mean_pool(df, "id", "v", "mask").collect()] == [(1, [2.0, 4.0])]
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = spark.createDataFrame([(1, "a question", "some text"), (2, None, "x"), (3, "a question", None)], "id long, q string, t string")
    got = {r.id: r.ids for r in K.pair_tokens(texts, "id", "q", "t", path).collect()}
    off = lambda x: [i + 1 for i in m.encode(x)]
    assert got == {1: K.pair(off("a question"), off("some text")), 2: K.pair([], off("x")), 3: K.pair(off("a question"), [])}


def test_embedder(spark):
    e = K.hashing_embedder(16)
    v = [r[0] for r in spark.createDataFrame([("one two",), ("two ONE",), (" ",), (None,)], "t string").select(e(F.col("t"))).collect()]
    assert v[0] == v[1] and np.isclose(np.linalg.norm(v[0]), 1) and v[2] == v[3] == [0.0] * 16
    x = spark.range(1)
    assert [x.select(K.instructed(F.lit("t"), k, h, "do")).first()[0] for k, h in (("query", False), ("passage", False), ("query", True), ("passage", True))] == ["query: t", "passage: t", "<instruct>do\n<query>t", "t"]


def test_archives(spark, tmp_path):
    def pack(name, entries):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, t in entries.items():
                z.writestr(n, t)
        (tmp_path / name).write_bytes(b.getvalue())
        return str(tmp_path / name)

    good = pack("g.zip", {"own-rep-1/src/a.cs": "class A { }", "own-rep-1/obj/b.cs": "x", "own-rep-1/c.cs": b"\xff\xfe"})
    assert {r.file_path: r.content for r in S.archive_files(spark, good).collect()} == {"src/a.cs": "class A { }", "c.cs": None}
    with pytest.raises(Exception, match="outside its folder"):
        S.archive_files(spark, pack("b.zip", {"top/../../evil.cs": "x"})).collect()
    assert [S.inside(x) for x in ("a/../b", "../a", "/a", "c:/a", "a\\..\\..\\b", "a/b")] == ["b", None, None, None, None, "a/b"]


def test_listings_and_history(spark):
    versions = json.dumps({"value": [{"path": "$/Root", "isFolder": True}, {"path": "$/root/a/B.cs"}]})
    blobs = json.dumps({"value": [{"path": "/x.cs", "gitObjectType": "blob"}, {"path": "/d", "gitObjectType": "tree"}, {"path": "/e", "isFolder": True}, {"path": "/f.cs"}]})
    df = spark.createDataFrame([(versions,), ("bad",)], "json string")
    assert [r.file_path for r in S.listing(df, "versions", "$/Root").collect()] == ["a/B.cs"]
    assert [r.file_path for r in S.listing(spark.createDataFrame([(blobs,)], "json string"), "blobs").collect()] == ["x.cs", "f.cs"]
    t = datetime.datetime
    h = spark.createDataFrame([("a", "Ann <a@b>", t(2020, 1, 2), 2), ("a", "Bo", t(2021, 1, 1), 3), ("b", "", t(2022, 5, 5), 1)], "file_path string, author string, ts timestamp_ntz, change_id long")
    assert sorted(map(tuple, S.history(h, True).collect())) == [("a", "Ann", "2020-01-02"), ("b", "Unknown", "2022-05-05")]
    assert sorted(map(tuple, S.history(h, False).collect()))[0] == ("a", "Bo", "2021-01-01")


def test_contents_by_reader(spark):
    def read(p):
        if p == "bad":
            raise OSError
        return p * 2

    got = S.contents(spark.createDataFrame([("a",), ("bad",), ("a",)], "file_path string"), read)
    assert sorted(map(tuple, got.collect())) == [("a", "aa"), ("bad", None)]


def test_http_retries():
    waits, calls = [], []

    def opener(_request, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {"Retry-After": "7"} if len(calls) == 1 else {}, None)
        return io.BytesIO(b"ok")

    assert http.get("http://host.example/", opener=opener, sleep=waits.append) == "ok" and waits == [7.0, 4.0]

    def denied(_request, timeout):
        raise urllib.error.HTTPError("u", 404, "none", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        http.get("http://host.example/", opener=denied, sleep=waits.append)
    found = iter([[], [], [1]])
    assert http.until_listed(lambda: next(found), sleep=waits.append) == [1] and waits[2:] == [2.0, 4.0]
    assert http.pause(9) == 30.0


def test_feedback_and_visits(spark):
    t = datetime.datetime(2024, 1, 1)
    f = api.feedback_rows(spark.createDataFrame([(t, " q ", "a", True), (t, None, "a", False)], "ts timestamp_ntz, question string, answer string, helpful boolean"))
    assert [(r.question, r.verdict) for r in f.collect()] == [("q", "UP"), ("", "DOWN")]
    v = api.visit_rows(spark.createDataFrame([(t, "GET", "/", "1.2.3.4:80"), (t, "POST", "/", "x"), (t, "get", "/INDEX.html", " "), (t, "GET", "/a.js", "x")], "ts timestamp_ntz, method string, path string, address string"))
    assert [r.client_ip for r in v.collect()] == ["1.2.3.4", None]


def test_usage_streams(spark, tmp_path):
    src, out, checks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    d = datetime.datetime
    rows = [(1, d(2024, 1, 1, 5), "warmup keepalive", 1.0), (2, d(2024, 1, 1, 6), "a", 2.5), (3, d(2024, 1, 2, 6), "b", 3.0), (4, d(2024, 1, 5), "c", 4.0)]
    schema = "event_id long, ts timestamp_ntz, q string, v double"
    spark.createDataFrame(rows, schema).write.parquet(src)

    def stream():
        return U.usage_stream(spark.readStream.schema(schema).parquet(src), F.col("q"), F.lit("search"), F.col("v"))

    for _ in range(2):
        U.append(stream(), out, checks).awaitTermination(60)
    assert sorted((r.event_id, r.duration_ms) for r in spark.read.parquet(out).collect()) == [(2, 2), (3, 3), (4, 4)]
    days = str(tmp_path / "days")
    U.append(U.daily_usage(stream()), days, checks + "d").awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(days).collect())) == [("2024-01-01", "search", 1), ("2024-01-02", "search", 1)]


@pytest.fixture(scope="module")
def service():
    """A repository service on this machine that fails each first listing and one content."""
    import http.server
    import threading
    from urllib.parse import parse_qs, urlparse

    seen = {}
    pages = {
        "versions": {"value": [{"path": "$/Root", "isFolder": True}, {"path": "$/Root/src/A.cs"}, {"path": "$/Root/bin/B.cs"}, {"path": "$/Root/Gone.cs"}]},
        "git": {"value": [{"path": "/src", "gitObjectType": "tree"}, {"path": "/src/A.cs", "gitObjectType": "blob"}, {"path": "/x.md", "gitObjectType": "blob"}, {"path": "/C d.cs"}]},
    }

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            q, body, code = parse_qs(u.query), b"", 200
            kind = "versions" if "/tfvc/" in u.path else "git"
            if u.path.startswith("/repos/"):
                if u.path.endswith("/own/rep"):
                    body = b'{"default_branch": "trunk"}'
                elif u.path.endswith("/zipball/trunk"):
                    out = io.BytesIO()
                    with zipfile.ZipFile(out, "w") as z:
                        z.writestr("own-rep-1/src/Z.cs", "class Z {}")
                        z.writestr("own-rep-1/obj/Y.cs", "class Y {}")
                    body = out.getvalue()
                else:
                    code = 404
            elif "recursionLevel" in q:
                seen[kind] = seen.get(kind, 0) + 1
                body = json.dumps(pages[kind] if seen[kind] > 1 else {"value": []}).encode()
            elif "Gone" in q["path"][0]:
                code = 404
            else:
                body = f"text of {q['path'][0]} {q.get('versionDescriptor.version', [''])[0]} {self.headers.get('Authorization', '')}".encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_hosted_repositories(spark, service):
    from lodestone.sources import remote

    remote.register(spark)
    read = lambda **o: {r.file_path: r.content for r in spark.read.format("repository").options(base=service, **o).load().collect()}
    assert read(kind="versions", project="P", root="$/Root", authorization="Basic eA==") == {"src/A.cs": "text of $/Root/src/A.cs  Basic eA==", "Gone.cs": None}
    assert read(kind="git", project="P", repo="r 1", branch="dev/x", tasks="2") == {"src/A.cs": "text of /src/A.cs dev/x ", "C d.cs": "text of /C d.cs dev/x "}
    assert read(kind="zip", repo="own/rep") == {"src/Z.cs": "class Z {}"}
    with pytest.raises(Exception, match="unknown kind"):
        read(kind="other")


def test_chat_answers_and_settings_of_builds(spark, root, tmp_path):
    store = Store(spark, str(tmp_path))
    embed = K.hashing_embedder(16)
    assert api.build_index(spark, S.local_files(spark, root), store, embed, "m", Settings(min_chunk_tokens=1, overlap_ceiling=0), dimension=16)
    e = api.Engine.open(spark, store, embed, "m", answerer=lambda q, c: F.concat(F.lit("answer to "), q))
    assert e.vector_index is not None and store.indexed() and int(store.manifest()["last_run"]) > 0
    assert "members" not in {r.chunk_type for r in e.chunks.select("chunk_type").collect()} and e.chunks.where(F.col("content").contains("// next: ")).count() == 0
    got = {r.query_id: r.answer for r in e.chat(spark.createDataFrame([(1, "enqueue order")], QUERIES)).collect()}
    assert got[1].startswith("answer to enqueue order\n\nSources:\n- src/")
    assert e.retry(spark.createDataFrame([(1, "enqueue order")], QUERIES)).first().answer.startswith("answer to Please answer in more detail: enqueue order")
    plain = api.Engine(spark, e.files, e.chunks, answerer=e.answerer)
    none = plain.chat(spark.createDataFrame([(2, "the a of")], QUERIES)).first()
    assert none.query_id == 2 and not none.grounded and "indexed codebase" in none.answer
    with pytest.raises(Exception, match="components"):
        api.build_index(spark, S.local_files(spark, root), store, embed, "m", dimension=8)
    assert store.count("files") == 2


def test_background_writes(spark, tmp_path):
    from lodestone.operators import usage

    rows = spark.createDataFrame([("a line",)], "value string")
    assert usage.append_later(rows, str(tmp_path / "log"), "text").result() and usage.append_later(rows, str(tmp_path / "log"), "text").result()
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    assert usage.append_later(rows, str(tmp_path / "log"), "no-such-format").result() is False
