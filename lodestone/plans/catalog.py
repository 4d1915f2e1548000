"""Registered queries of the retrieval engine and their SQL twins.

The driver tables stand for the engine's own: a document is a file, its lines
are chunks, and the vector of the same id belongs to a file's first line.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..models import tokenizers
from ..operators import chunks as C
from ..operators import fulltext, hybrid, lexical, parsed, rerank, usage, vectors
from ..operators.fulltext import TextIndex
from ..sources import files as sources
from ..sources import store
from ..streaming import usage as usage_stream

FLAGSHIP = "hybrid_rrf"
REQUESTS = [(1, "Licensed under the Apache License", 3), (2, "heed handing the erbleor", 10), (3, "schach einpfau lich", 25), (4, "src3 fr L2", -1)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def requests(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame(REQUESTS, "query_id long, text string, vec_id long")
    return r.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left")


def files(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("file_type"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("class_name"), F.col("source").alias("namespace"), F.posexplode(F.split("text", "\n")).alias("seq", "content")).where(F.col("content").rlike(r"\S"))
    return x.select((F.col("file_id") * 100000 + F.col("seq")).alias("chunk_id"), "file_id", "seq", F.concat(F.lit("L"), F.col("seq") + 1).alias("name"), F.when(F.col("seq") == 0, "head").otherwise("line").alias("chunk_type"), "content", "class_name", "namespace")


_BUILT: dict[tuple, TextIndex] = {}


def text_index(spark: SparkSession, d: str, name: str) -> TextIndex:
    """The stored index of "files" or "lines" over all their text columns.

    It is built by the first query of an application that asks for it, and
    again if a file of the table has another size or time.
    """
    key = (spark.sparkContext.applicationId, d, name, *store.stamps(spark, f"{d}/documents.parquet"))
    if key not in _BUILT:
        root = f"{store.shared_root(spark)}/text-{name}-{uuid.uuid4().hex}"
        df, id_col = (files(spark, d), "file_id") if name == "files" else (lines(spark, d), "chunk_id")
        TextIndex.over(df, id_col, hybrid.file_text(df) if name == "files" else hybrid.chunk_text(df)).write(root)
        _BUILT[key] = TextIndex.open(spark, root)
    return _BUILT[key]


def line_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") * 100000).alias("chunk_id"), "embedding")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).join(line_vectors(spark, d), "chunk_id", "left")


_R = "r as (select * from (values " + ", ".join(f"({q}::bigint, '{t}', {v}::bigint)" for q, t, v in REQUESTS) + ") as x(query_id, text, vec_id))"
_V = "rv as (select query_id, embedding as q from r join embeddings using (vec_id))"
_COS = "list_sum(list_transform(list_zip(v, q), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(v, lambda p: p::double * p::double))) * sqrt(list_sum(list_transform(q, lambda p: p::double * p::double))))"
_LINES = r"""l as (select doc_id as file_id, lang as class_name, source as namespace, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seq from documents),
lines as (select file_id * 100000 + seq as chunk_id, file_id, seq, 'L' || (seq + 1) as name, case when seq = 0 then 'head' else 'line' end as chunk_type, content, class_name, namespace from l where regexp_matches(content, '\S'))"""


_CHUNK_TEXT = "select chunk_id as id, concat_ws(' ', content, name, class_name, namespace) as content, chunk_type from lines"
_FILE_TEXT = "select doc_id as id, concat_ws(' ', source || '/' || lang || '/' || doc_id || '.txt', text, lang) as content from documents"


def _bm25(out: str, source: str) -> str:
    tok = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}0-9]+'), lambda t: t <> '')"
    return f"""{out}_t as (select distinct query_id, unnest({tok.format('text')}) as term from r),
{out}_d as (select id, {tok.format('content')} as ts from ({source})),
{out}_s as (select count(*) as n, avg(len(ts)) as mean from {out}_d),
{out}_x as (select id, len(ts) as dl, unnest(ts) as term from {out}_d),
{out}_tf as (select id, dl, term, count(*) as tf from {out}_x where term in (select term from {out}_t) group by all),
{out}_df as (select term, count(*) as df from {out}_tf group by term),
{out}_p as (select id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)) as part from {out}_tf join {out}_df using (term), {out}_s),
{out}_q as (select query_id, id, round(sum(part), 6) as s from {out}_p join {out}_t using (term) group by all),
{out} as (select query_id, id, round(1000 * s / (s + 10))::int as rank from {out}_q)"""


def _ranked(name: str, floor: int = 10) -> str:
    return f"select query_id, id, rank, row_number() over (partition by query_id order by rank desc, id)::int as pos from {name} where rank >= {floor}"


def _vector(source: str, k: int, most: float) -> str:
    return f"select * from (select *, row_number() over (partition by query_id order by distance, id)::int as pos from (select query_id, id, round(1 - {_COS}, 6) + 0 as distance from ({source}), rv) where distance <= {most}) where pos <= {k}"


def _hybrid(kind: str = "true", text: bool = True, top: int = 20) -> str:
    none = "select null::bigint as query_id, null::bigint as id, null::int as rank, null::int as pos where false"
    return f"""with {_R}, {_V}, {_LINES},
v as ({_vector(f'select chunk_id as id, embedding as v from lines join embeddings on chunk_id = vec_id * 100000 where {kind}', 200, 1.0)}),
{_bm25('cf', _CHUNK_TEXT)}, ck as (select cf.* from cf join lines on id = chunk_id where {kind}), c as ({_ranked('ck') if text else none}),
{_bm25('ff', _FILE_TEXT)}, f as ({_ranked('ff') if text else none}),
one as (select query_id, chunk_id, max(distance) as distance, max(vpos) as vpos, max(cpos) as cpos, max(fpos) as fpos from (
 select query_id, id as chunk_id, distance, pos as vpos, null::int as cpos, null::int as fpos from v
 union all select query_id, id, null, null, pos, null from c
 union all select query_id, chunk_id, null, null, null, pos from f join lines on f.id = file_id) group by all),
s as (select *, coalesce(60 * (1e0 / (60 + vpos)), 0e0) as a, coalesce(30 * (1e0 / (60 + cpos)), 0e0) as b, coalesce(30 * (1e0 / (60 + fpos)), 0e0) as c from one),
t as (select *, round(a + b + c, 6) as score, case when a > 0 and (b > 0 or c > 0) then 'Hybrid' when a > 0 then 'Vector' else 'FullText' end as match_source from s),
h as (select query_id, row_number() over (partition by query_id order by score desc, chunk_id)::int as pos, chunk_id, chunk_id // 100000 as file_id, score, round(a, 6) as vector_rrf, round(b, 6) as chunk_fts_rrf, round(c, 6) as file_fts_rrf, distance, match_source from t)
select * from h where pos <= {top}"""


def _run_hybrid(spark, d, **kw) -> DataFrame:
    r = requests(spark, d)
    if kw.pop("blank", False):
        r = r.withColumn("text", F.lit(" "))
    return hybrid.hybrid_search(spark, r, files(spark, d), lines(spark, d), file_index=text_index(spark, d, "files"), chunk_index=text_index(spark, d, "lines"), vectors=line_vectors(spark, d), **kw)


@query(f"with {_R}, {_V} " + _vector("select vec_id as id, embedding as v from embeddings", 20, 2.0))
def vector_topk(spark, d):
    return vectors.vector_topk(spark, table(spark, d, "embeddings"), requests(spark, d), 20, 2.0)


@query(f"with {_R}, {_V} " + _vector("select vec_id as id, embedding as v from embeddings where label < 5", 50, 0.95))
def vector_topk_filtered(spark, d):
    return vectors.vector_topk(spark, table(spark, d, "embeddings").where("label < 5"), requests(spark, d), 50, 0.95)


@query(f"with {_R}, {_V} select query_id, vec_id, round({_COS}, 6) + 0 as similarity from (select vec_id, embedding as v from embeddings), rv")
def cosine_pairwise(spark, d):
    q = requests(spark, d).where("vector is not null").select("query_id", "vector")
    return table(spark, d, "embeddings").crossJoin(F.broadcast(q)).select("query_id", "vec_id", (F.round(vectors.cosine_similarity(F.col("embedding"), F.col("vector")), 6) + 0e0).alias("similarity"))


@query("select vec_id, i - 1 as dim, round(v / n, 6) + 0 as v from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i, sqrt(list_sum(list_transform(embedding, lambda p: p::double * p::double))) as n from embeddings)")
def l2_normalise(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalised(F.col("embedding"))).alias("dim", "v"))
    return x.select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round("v", 6) + 0e0).alias("v"))


@query(f"with {_R}, {_V} " + _vector("select vec_id as id, embedding as v from embeddings", 20, 2.0))
def vector_index_topk(spark, d):
    """The search by cells with every cell probed, which is exact; tests measure the recall of fewer."""
    index = vectors.VectorIndex.build(spark, table(spark, d, "embeddings"), f"{store.shared_root(spark)}/cells-{uuid.uuid4().hex}", cells=16)
    return index.search(spark, requests(spark, d), 20, 2.0, probes=16)


@query(f"with {_R}, {_LINES}, {_bm25('cf', _CHUNK_TEXT)} {_ranked('cf')}")
def chunk_fts_bm25(spark, d):
    return fulltext.ranked(fulltext.bm25(text_index(spark, d, "lines"), requests(spark, d)), 10)


@query(f"with {_R}, {_bm25('ff', _FILE_TEXT)} {_ranked('ff')}")
def file_fts_bm25(spark, d):
    return fulltext.ranked(fulltext.bm25(text_index(spark, d, "files"), requests(spark, d)), 10)


@query(_hybrid())
def hybrid_rrf(spark, d):
    return _run_hybrid(spark, d)


@query(_hybrid("chunk_type = 'head'"))
def hybrid_chunk_type(spark, d):
    return _run_hybrid(spark, d, chunk_type="head")


@query(_hybrid(text=False))
def hybrid_no_text(spark, d):
    return _run_hybrid(spark, d, blank=True)


@query(f"select query_id, match_source, count(*) as n from ({_hybrid()}) group by all")
def match_source_counts(spark, d):
    return _run_hybrid(spark, d).groupBy("query_id", "match_source").agg(F.count("*").alias("n"))


_SCORED = "select source as query_id, doc_id as position, (doc_id * 7919 % 1000) / 1000e0 as rerank_score, doc_id % 3 <> 0 as lexical from documents"


def _scored(spark, d) -> DataFrame:
    s = F.col("doc_id")
    return table(spark, d, "documents").select(F.col("source").alias("query_id"), s.alias("position"), (s * 7919 % 1000 / F.lit(1000e0)).alias("rerank_score"), (s % 3 != 0).alias("lexical"))


@query(f"select query_id, position, rerank_score, lexical from (select *, max(rerank_score) over (partition by query_id) as top from ({_SCORED})) where top >= 1e-6 and rerank_score >= case when lexical then top * 0.1 else greatest(top * 0.1, 0.05) end")
def relevance_gate(spark, d):
    return hybrid.relevance_gate(_scored(spark, d))


@query(f"select query_id, position, rerank_score, lexical from (select *, max(rerank_score) over (partition by query_id) as top from ({_SCORED})) where top >= 1e-6 and rerank_score >= case when lexical then 0 else 0.5 end")
def gate_vector_only(spark, d):
    return hybrid.relevance_gate(_scored(spark, d), Settings(min_score_ratio=0.0, min_vector_only_score=0.5))


@query("select doc_id, round(1 - 0.001 * (row_number() over (partition by source order by doc_id) - 1), 6) as score from documents")
def rerank_fallback(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", F.round(hybrid.rerank_fallback(F.row_number().over(w) - 1), 6).alias("score"))


_FILES = "files as (select doc_id as file_id, source || '/' || lang || '/' || doc_id || '.txt' as file_path, text as content, lang as file_type from documents)"


@query(f"with {_FILES} select file_id, file_path from files where file_path ilike '%SRC1/en%' order by file_path limit 20")
def filename_search(spark, d):
    return lexical.filename_search(files(spark, d), "SRC1/en", 20).select("file_id", "file_path")


@query("select p_partkey, p_name from part where p_name ilike '%widget%' or p_type ilike '%widget%' or p_name ilike '%small%' or p_type ilike '%small%' order by length(rtrim(p_name)), p_name || p_partkey limit 25")
def identifier_search(spark, d):
    p = table(spark, d, "part").withColumn("file_path", F.concat("p_name", F.col("p_partkey").cast("string")))
    return lexical.identifier_search(p, ["widget", "small"], ["p_name", "p_type"], "p_name", 25).select("p_partkey", "p_name")


@query(r"with c as (select event_id, case when event_id % 3 = 0 then 'x.' else 'x' end || case event_id % 5 when 0 then 'value' when 1 then 'Value' when 2 then 'ValueList' else event_type end || ' = ' || props as t from events) select event_id from c where t ilike '%.value =%' or t ilike '%.Value =%' or t ilike '%.Value% =%'")
def field_assignment(spark, d):
    at = F.col("event_id")
    field = F.when(at % 5 == 0, "value").when(at % 5 == 1, "Value").when(at % 5 == 2, "ValueList").otherwise(F.col("event_type"))
    t = F.concat(F.when(at % 3 == 0, "x.").otherwise("x"), field, F.lit(" = "), F.col("props"))
    return table(spark, d, "events").where(lexical.assigns_field(t, "value")).select("event_id")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""select item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[ ,?!.''"]+'), lambda t: lower(t)), lambda t: length(t) > 2 and t not in ({_STOP})))), ' ') as words from benchmark""")
def keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("words"))


@query(r"""select doc_id, array_to_string(list_filter(regexp_split_to_array(source || ' SearchIndex' || doc_id || ' XMLReader lowercase', '[ ,?!.''"()]+'), lambda t: length(t) >= 8 and regexp_matches(t, '^\p{Lu}') and regexp_matches(t, '\p{Lu}.*\p{Lu}') and regexp_matches(t, '\p{Ll}')), ' ') as terms from documents""")
def pascal_terms(spark, d):
    x = F.concat(F.col("source"), F.lit(" SearchIndex"), F.col("doc_id").cast("string"), F.lit(" XMLReader lowercase"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.pascal_terms(x), " ").alias("terms"))


@query("""with names as (select distinct s_name as name from supplier where length(s_name) >= 8), t as (select distinct substring(s_name, 1, 9) || reverse(substring(s_name, 10, 2)) || substring(s_name, 12, 99) as term from supplier),
p as (select term, name, levenshtein(term, name) as edits from t, names where abs(length(term) - length(name)) <= 3)
select term, x.name as name, x.edits as edits from (select term, min({'edits': edits, 'name': name}) as x from p where edits <= 3 group by term)""")
def fuzzy_nearest(spark, d):
    s = table(spark, d, "supplier")
    bent = F.concat(F.substring("s_name", 1, 9), F.reverse(F.substring("s_name", 10, 2)), F.substring("s_name", 12, 99))
    return lexical.fuzzy_nearest(s.select(bent.alias("term")), s.select(F.col("s_name").alias("name")))


@query(f"""with {_R}, {_FILES}, {_bm25('ff', _FILE_TEXT)},
k as (select file_path, file_type as class_name, rank from ff join files on id = file_id where query_id = 1),
b as (select * from k union all select file_path, class_name, null from (select file_path, file_type as class_name from files where file_path ilike '%src1/en%' order by file_path limit 10) where file_path not in (select file_path from k)),
s as (select file_path, class_name, rank, case when rank is null then 100 else greatest(0e0, 100 - 5 * greatest(0e0, 20 - rank / 50.0)) end::double + case when contains('licensed under the apache license', class_name) then 200 else 0 end as score from b)
select file_path, class_name, rank, round(score, 6) as score, row_number() over (order by score desc, rank desc nulls last, file_path)::int as pos from s order by score desc, rank desc nulls last, file_path limit 20""")
def fts_only_blend(spark, d):
    f = files(spark, d).select("file_id", "file_path", F.col("file_type").alias("class_name"))
    k = fulltext.bm25(text_index(spark, d, "files"), requests(spark, d).where("query_id = 1")).join(f, F.col("id") == f.file_id).select("file_path", "class_name", "rank")
    n = lexical.filename_search(f, "src1/en", 10).select("file_path", "class_name", F.lit(None).cast("int").alias("rank"))
    return lexical.blend(k, n, REQUESTS[0][1], 20).withColumn("score", F.round("score", 6))


@query("select coalesce(nullif(event_type, ''), '(none)') as name, count(*) as n from events group by event_type")
def facets(spark, d):
    return usage.facets(table(spark, d, "events"), "event_type")


@query(f"with {_LINES} select count(*) as total, count(embedding) as embedded, case when count(*) = 0 or count(embedding) = 0 then 'Red' when count(embedding) < count(*) then 'Yellow' else 'Green' end as status, count(*) > 0 and count(embedding) = count(*) as healthy from lines left join embeddings on chunk_id = vec_id * 100000")
def index_health(spark, d):
    return usage.index_health(chunks(spark, d), True)


@query("select 'documents' as name, count(*) as n from documents")
def collection_stats(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n")


_CACHE = """cache as (select u.text as query, a.text as answer, u.conv_id * 1000 + u.turn as seq from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
asked as (select item_id as id, text as query from benchmark union all select conv_id * 1000 + turn + 1000000, case when turn % 4 = 0 then text else lower(text) || ' ' end from conversations where role = 'user'),
e as (select query, arg_max(answer, seq) as a from cache group by query), n as (select lower(trim(query)) as q, arg_max(answer, seq) as a from cache group by 1),
look as (select id, coalesce(e.a, n.a) as answer, case when e.a is not null then 'exact' when n.a is not null then 'normalised' else 'miss' end as level from asked left join e using (query) left join n on lower(trim(asked.query)) = n.q)"""


def _lookup(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    cache = u.join(a, ["conv_id", "turn"]).select(F.col("text").alias("query"), "answer", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    asked = asked.unionByName(u.select((F.col("conv_id") * 1000 + F.col("turn") + 1000000).alias("id"), F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(F.concat(F.lower("text"), F.lit(" "))).alias("query")))
    return usage.cache_lookup(asked, cache)


@query(f"with {_CACHE} select * from look")
def cache_lookup(spark, d):
    return _lookup(spark, d)


@query(f"with {_CACHE} select count(*) as asked, count(*) filter (level <> 'miss') as hits, count(*) filter (level = 'miss') as misses, round(coalesce(count(*) filter (level <> 'miss') / nullif(count(*), 0), 0), 6) as hit_rate from look")
def cache_stats(spark, d):
    return usage.cache_stats(_lookup(spark, d))


@query("select event_id, ts, case when event_type in ('click', 'view') then 'search' when event_type = 'purchase' then 'ask' else 'feedback' end as event_type, substring(trim(coalesce(props, '')), 1, 400) as question, greatest(0, least(trunc(value), 2147483647))::int as duration_ms from events where lower(trim(substring(trim(coalesce(props, '')), 1, 400))) <> 'warmup keepalive'")
def telemetry_append(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "search").when(F.col("event_type") == "purchase", "ask").otherwise("feedback")
    return usage.usage_rows(table(spark, d, "events"), F.col("props"), kind, F.col("value"))


@query("select cast(ts as date)::varchar as day, event_type, count(*) as n from events group by all")
def telemetry_usage_daily(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(r"select page_id, (regexp_matches(p, '(?i)^(.*/)?[^/]*\.html$') or regexp_matches(p, '(?i)^.*example\.com/en/.*$')) and not regexp_matches(p, '(?i)^(.*/)?de/.*$') as listed from (select page_id, regexp_replace(replace(url, chr(92), '/'), '^/+', '') as p from pages)")
def glob_filter(spark, d):
    return table(spark, d, "pages").select("page_id", T.glob_match(F.col("url"), ["**/*.html", "**example.com/en/**"], ["**/de/**"]).alias("listed"))


@query(r"""with x as (select page_id, regexp_replace(regexp_replace(trim(regexp_replace(url, '[?#].*$', '')), '/+$', ''), '(?i)\.git$', '') as u from pages)
select page_id, regexp_extract(u, '^(?:https?://[^/]+/|[^@/]+@[^:/]+:)?([^/:\s]+)/([^/:\s]+)$', 1) as owner, regexp_extract(u, '^(?:https?://[^/]+/|[^@/]+@[^:/]+:)?([^/:\s]+)/([^/:\s]+)$', 2) as repo from x""")
def repo_url_parse(spark, d):
    r = T.repo_parts(F.regexp_replace("url", r"[?#].*$", ""))
    return table(spark, d, "pages").select("page_id", r["owner"].alias("owner"), r["repo"].alias("repo"))


_IP = "case event_id % 4 when 0 then '10.0.' || user_id || '.1:8080, 10.1.1.1' when 1 then '2001:db8::' || user_id when 2 then ' ' else '10.0.0.' || user_id end"


@query(f"with x as (select event_id, trim(split_part({_IP}, ',', 1)) as h from events) select event_id, nullif(substring(case when length(h) - length(replace(h, ':', '')) = 1 then split_part(h, ':', 1) else h end, 1, 45), '') as ip from x")
def ip_normalise(spark, d):
    return table(spark, d, "events").select("event_id", T.client_ip(F.expr(_IP)).alias("ip"))


@query(r"select doc_id, (len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) * 6 // 5)::int as tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"select doc_id, case when len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) <= 42 then text else regexp_extract(text, '^\s*(?:\S+\s+){41}\S+', 0) end as preview from documents")
def leading_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("""with k as (select doc_id, source || '/' || lang || '/' || doc_id || ':line:L1:1' as key from documents)
select doc_id, key, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(key, ''), lambda c: ascii(c)::hugeint)), lambda h, c: xor(h, c) * 16777619 & 4294967295)::bigint as hash from k""")
def chunk_key_fnv(spark, d):
    key = F.concat_ws(":", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit("line"), F.lit("L1"), F.lit("1"))
    return table(spark, d, "documents").select("doc_id", key.alias("key"), T.fnv1a(key).alias("hash"))


@query(f"with h as ({_hybrid(top=8)}), x as (select h.query_id, h.pos, 'doc' || h.file_id as source, content from h join (with {_LINES} select chunk_id, content from lines) using (chunk_id)) select query_id, string_agg('// File: ' || source || chr(10) || content || chr(10) || chr(10), '' order by pos) as context, true as grounded from x group by query_id")
def chat_context(spark, d):
    h = lines(spark, d).select("chunk_id", "content").join(F.broadcast(_run_hybrid(spark, d, top_n=8)), "chunk_id")
    x = usage.chat_context(h.select("query_id", "pos", F.concat(F.lit("doc"), F.col("file_id").cast("string")).alias("source"), "content"))
    return x.select("query_id", "context", "grounded")


@query(r"select conv_id, turn, coalesce(regexp_matches(text, '\S'), false) as grounded from conversations")
def grounding_guard(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.grounded(F.col("text")).alias("grounded"))


@query("select source, count(*) as listed, count(*) filter (lang <> 'es') as staged, count(*) filter (lang <> 'es') >= floor(count(*) * 0.95) as complete from documents group by source")
def completion_guard(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("listed"), F.count_if(F.col("lang") != "es").alias("staged"))
    return g.withColumn("complete", F.col("staged") >= F.floor(F.col("listed") * F.lit(Settings().promotion_ratio)))


_EST = r"(len(list_filter(regexp_split_to_array(content, '\s+'), lambda t: t <> '')) * 6 // 5)"


@query(f"""with {_LINES}, x as (select *, {_EST} < 50 as small from lines), y as (select *, case when small and coalesce(lag(small) over (partition by file_id order by seq), false) then 0 else 1 end as edge from x),
z as (select *, sum(edge) over (partition by file_id order by seq) as run from y)
select file_id, min(seq)::int as seq, case when count(*) > 1 then 'members' else 'line' end as chunk_type, string_agg(name, '+' order by seq) as name, string_agg(content, chr(10) || chr(10) order by seq) as content from z group by file_id, run""")
def merge_undersized(spark, d):
    return C.merge_undersized(lines(spark, d))


@query(rf"""with {_LINES}, x as (select *, lead(content) over (partition by file_id order by seq) as nxt from lines)
select chunk_id, case when nxt is not null and {_EST} < 380 then content || chr(10) || '// next: ' || case when len(list_filter(regexp_split_to_array(nxt, '\s+'), lambda t: t <> '')) <= 42 then nxt else regexp_extract(nxt, '^\s*(?:\S+\s+){{41}}\S+', 0) end else content end as content from x""")
def sibling_overlap(spark, d):
    return C.sibling_overlap(lines(spark, d)).select("chunk_id", "content")


@query(rf"""with recursive l as (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
n as (select *, (len(list_filter(regexp_split_to_array(line, '\s+'), lambda t: t <> '')) * 6 // 5) as size from l),
g as (select id, i, line, size, 1 as part, size as used from n where i = 1
union all select n.id, n.i, n.line, n.size, case when g.used + n.size > 400 then g.part + 1 else g.part end, case when g.used + n.size > 400 then n.size else g.used + n.size end from g join n on n.id = g.id and n.i = g.i + 1)
select id, part::int as part, (max(part) over (partition by id))::int as parts, content from (select id, part, string_agg(line, chr(10) order by i) as content from g group by id, part)""")
def split_oversized(spark, d):
    return C.split_oversized(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("select doc_id, case when pos > 0 and length(text) > 1500 then substring(text, 1, 1500) || chr(10) || '... [truncated] ...' else text end as content from (select *, row_number() over (partition by source order by doc_id) - 1 as pos from documents)")
def content_truncation(spark, d):
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, d, "documents").select("doc_id", "text", pos.alias("pos")).select("doc_id", T.truncated(F.col("text"), F.col("pos")).alias("content"))


@query(f"with {_R}, {_LINES}, {_bm25('ff', _FILE_TEXT)}, f as ({_ranked('ff')}) select query_id, chunk_id, pos as fpos from f join lines on f.id = file_id")
def file_hits_expand(spark, d):
    f = fulltext.ranked(fulltext.bm25(text_index(spark, d, "files"), requests(spark, d)), 10)
    return f.select("query_id", F.col("id").alias("file_id"), F.col("pos").alias("fpos")).join(lines(spark, d).select("file_id", "chunk_id"), "file_id").select("query_id", "chunk_id", "fpos")


@query(f"""with s as ({_SCORED}), w as (select *, count(*) over (partition by query_id) as n, max(rerank_score) over (partition by query_id) as top from s),
k as (select * from w where n = 1 or (top >= 1e-6 and rerank_score >= case when lexical then top * 0.1 else greatest(top * 0.1, 0.05) end))
select query_id, position, row_number() over (partition by query_id order by rerank_score desc, position)::int as pos from k""")
def rerank_order(spark, d):
    s = _scored(spark, d)
    return rerank.join_scores(s.drop("rerank_score"), s.select("query_id", "position", "rerank_score")).select("query_id", "position", "pos")


@query(f"select query_id, position from (select *, max(s) over (partition by query_id) as top from (select *, case when query_id < 'src5' then rerank_score * 1e-9 else rerank_score end as s from ({_SCORED}))) where top >= 1e-6 and s >= case when lexical then top * 0.1 else greatest(top * 0.1, 0.05) end")
def gate_degenerate_empty(spark, d):
    """Some queries have no score worth anything, and keep nothing; the others do."""
    s = _scored(spark, d)
    s = s.withColumn("rerank_score", F.when(F.col("query_id") < "src5", F.col("rerank_score") * 1e-9).otherwise(F.col("rerank_score")))
    return hybrid.relevance_gate(s).select("query_id", "position")


@query(f"""with s as ({_SCORED}), b as (select query_id, count(*) as had, count(*) filter (lexical) as vector_backed, max(rerank_score) as top from s group by query_id),
k as (select query_id, count(*) as kept from s join b using (query_id) where rerank_score >= case when lexical then top * 0.1 else greatest(top * 0.1, 0.05) end group by query_id)
select query_id, vector_backed, had - coalesce(kept, 0) as dropped from b left join k using (query_id)""")
def gate_dropped(spark, d):
    s = _scored(spark, d).withColumn("match_source", F.when(F.col("lexical"), "Hybrid").otherwise("FullText"))
    return rerank.dropped(s, hybrid.relevance_gate(s))


@query(f"with {_FILES}, n as (select * from files where file_path ilike '%src1/%'), f as (select * from files where file_type = 'en') select file_id, file_path from f union all select file_id, file_path from n where file_path not in (select file_path from f)")
def filename_merge_anti(spark, d):
    f = files(spark, d)
    hits, named = f.where("file_type = 'en'"), f.where(F.col("file_path").ilike("%src1/%"))
    return hits.unionByName(named.join(hits.select("file_path"), "file_path", "left_anti")).select("file_id", "file_path")


@query("select p_partkey, round(case when p_size % 7 = 0 then 100 else least(100, (p_size * 37) / 10) end, 6)::double as score from part")
def fts_score(spark, d):
    rank = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 37)
    return table(spark, d, "part").select("p_partkey", F.round(lexical.fts_score(rank), 6).alias("score"))


@query("select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10")
def cache_stats_top10(spark, d):
    return usage.top_queries(table(spark, d, "events"), "user_id")


@query(f"with {_CACHE} select id, answer from look where level <> 'miss'")
def known_answers(spark, d):
    return _lookup(spark, d).where("level <> 'miss'").select("id", "answer")


@query("""with h as (select props as author, user_id::varchar as file_path, ts, event_id from events),
o as (select file_path, min({'ts': ts, 'i': event_id}) as a, max({'ts': ts, 'i': event_id}) as b from h group by file_path)
select file_path, 'User' || (a.i % 7) as oldest, strftime(a.ts, '%Y-%m-%d') as added, 'User' || (b.i % 7) as newest, strftime(b.ts, '%Y-%m-%d') as changed from o""")
def author_oldest_newest(spark, d):
    who = F.concat(F.lit("User"), (F.col("event_id") % 7).cast("string"), F.lit(" <mail@host.example>"))
    h = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), who.alias("author"), "ts", F.col("event_id").alias("change_id"))
    a = sources.history(h, True).withColumnsRenamed({"author": "oldest", "day": "added"})
    return a.join(sources.history(h, False).withColumnsRenamed({"author": "newest", "day": "changed"}), "file_path")


@query("select label as id, i - 1 as dim, round(avg(v), 6) + 0 as v from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings where vec_id % 3 <> 0) group by all")
def mean_pool(spark, d):
    e = table(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    p = tokenizers.mean_pool(e, "label", "embedding", "mask")
    return p.select("id", F.posexplode("pooled").alias("dim", "v")).select("id", F.col("dim").cast("long").alias("dim"), (F.round("v", 6) + 0e0).alias("v"))


LETTERS = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]"] + [m + c for c in "abcdefghijklmnopqrstuvwxyz0123456789#" for m in ("", "##")])}


@query(r"""with k as (select p_partkey as id, unnest(regexp_extract_all(lower(p_name), '\S+')) as word, generate_subscripts(regexp_extract_all(lower(p_name), '\S+'), 1) as wi from part),
c as (select id, wi, unnest(string_split(word, '')) as c, generate_subscripts(string_split(word, ''), 1) as ci from k),
t as (select id, wi, ci, 3 + 2 * (strpos('abcdefghijklmnopqrstuvwxyz0123456789#', c) - 1) + case when ci = 1 then 0 else 1 end as token from c)
select id, '1,' || string_agg(token::varchar, ',' order by wi, ci) || ',2' as ids from t group by id""")
def wordpiece_tokens(spark, d):
    x = tokenizers.wordpiece_tokens(table(spark, d, "part"), "p_partkey", "p_name", LETTERS)
    return x.select("id", F.array_join(F.transform("ids", lambda t: t.cast("string")), ",").alias("ids"))


# One file of code for each part; {k} is its key, {n} its size, {name} its name.
CODE = """using System;
using Shop.Parts;
namespace Shop.N{n}
{
    /// "}" in a comment
    [Serializable]
    public sealed class Part{k} : Base{n}<Item>, IPart
    {
        #region Fields {n}
        public const int Size = {n};
        private static int made{n} = 0;
        private Dictionary<string, Item{k}> byName;
        public event EventHandler Changed{n};
        public delegate void Notify{k}(int a);
        #endregion
        public string Name { get; set; } = "{{name}";
        public Part{k}(int a) { Size = a; }
        public override int Price{k}(Item x) { return x.Cost; }
        public virtual async Task Load{n}() { var q = "SELECT a FROM t WHERE b"; await q; }
        protected abstract void Draw{k}();
    }
    public enum Kind { None, A{n} }
    public interface IShop{k} { void Open(); }
}
"""


def _code(spark, d) -> DataFrame:
    k, code = F.col("p_partkey").cast("string"), F.lit(CODE)
    for mark, value in (("{k}", k), ("{n}", F.col("p_size").cast("string")), ("{name}", F.col("p_name"))):
        code = F.replace(code, F.lit(mark), value)
    return table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/"), k, F.lit(".cs")).alias("file_path"), code.alias("content"))


@query("""select p_partkey as file_id, 'class' as file_type, 'Shop.N' || n as namespace, 'Part' || k as class_name, 'public sealed' as class_modifiers, 'Base' || n || '<Item>' as base_class, 'IPart' as interfaces,
'Part' || k || ' IShop' || k as class_names, 'Name' as property_names, 'string Name' as properties, 'Price' || k || ' Load' || n || ' Draw' || k || ' Open' as method_names, 'public Part' || k || '(int a)' as constructors, 'Price' || k as overridden_methods,
'Draw' || k as abstract_methods, 'Load' || n as virtual_methods, 'Load' || n as async_methods, 'Kind(A' || n || ')' as enum_values, 'Size' as constants, 'made' || n as static_fields, 'Serializable' as attributes, 'Changed' || n as events, 'Notify' || k as delegates,
'Base' || n || ' Dictionary' as generic_types, 'Base' || n || ' Dictionary EventHandler IPart Item Item' || k || ' Task var' as referenced_types, 'Dictionary<string, Item' || k || '>' as dictionaries, 'SELECT WHERE' as sql_operations, 'Shop.Parts System' as usings, 'Fields ' || n as regions
from (select p_partkey, p_partkey::varchar as k, p_size::varchar as n from part)""")
def extract_metadata(spark, d):
    """All fields, with separators of lists shown as a space."""
    x = parsed.extract_metadata(_code(spark, d))
    whole = ("file_id", "constructors", "dictionaries", "enum_values")
    return x.select(*[f if f in whole else F.regexp_replace(f, r"\s*[|,;]\s*", " ").alias(f) for f in x.columns])


_PART = "(select p_partkey, p_partkey::varchar as k, p_size::varchar as n from part)"
_KINDS = """(values (0, 'class', 'Part' || k, 'Part' || k, 6, 21, ''), (1, 'members', 'Part' || k || '+Price' || k, 'Part' || k, 17, 18, ''), (2, 'method', 'Load' || n, 'Part' || k, 19, 19, 'public virtual async Task Load' || n || '()'),
(3, 'method', 'Draw' || k, 'Part' || k, 20, 20, 'protected abstract void Draw' || k || '()'), (4, 'interface', 'IShop' || k, 'IShop' || k, 23, 23, 'interface IShop' || k)) as c(seq, chunk_type, name, class_name, start_line, end_line, signature)"""


@query(f"select p_partkey as file_id, seq, chunk_type, name, class_name, start_line, end_line from {_PART}, lateral (select * from {_KINDS})")
def chunk_files(spark, d):
    return parsed.chunk_files(_code(spark, d)).select("file_id", "seq", "chunk_type", "name", "class_name", "start_line", "end_line")


@query(f"""select p_partkey as file_id, seq, signature, 'Shop.N' || n as namespace, case when seq < 4 then 'Part' || k || ' : Base' || n || '<Item>, IPart' else '' end as parent_context, 'src/' || k || '.cs:' || chunk_type || ':' || name || ':' || start_line as chunk_key,
case when seq = 0 then 'using System;' when seq < 4 then '// File: src/' || k || '.cs' else 'public interface IShop' || k || ' {{ void Open(); }}' end as first_line, seq in (1, 2) as shows_next
from {_PART}, lateral (select * from {_KINDS})""")
def chunk_details(spark, d):
    """Signatures, contexts, keys, the first line, and whether the next member's preview is appended."""
    x = parsed.chunk_files(_code(spark, d))
    return x.select("file_id", "seq", "signature", "namespace", "parent_context", "chunk_key", F.split("content", "\n")[0].alias("first_line"), F.col("content").contains("// next: ").alias("shows_next"))


@query("select file_id, seq, chunk_key from (select *, row_number() over (partition by chunk_key order by file_id, seq) as n from (select doc_id as file_id, (doc_id % 3)::int as seq, lang || doc_id % 50 as chunk_key from documents)) where n = 1")
def unique_chunks(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(i.alias("file_id"), (i % 3).cast("int").alias("seq"), F.concat("lang", (i % 50).cast("string")).alias("chunk_key"))
    return parsed.unique_chunks(c)[0].select("file_id", "seq", "chunk_key")


@query("select p_partkey, upper(p_name[1]) || p_name[2:] as name from part")
def first_upper(spark, d):
    return table(spark, d, "part").select("p_partkey", T.first_upper(F.col("p_name")).alias("name"))


@query(r"select page_id, regexp_replace(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '\.[^.]*$', '') as stem from pages")
def file_stem(spark, d):
    return table(spark, d, "pages").select("page_id", T.stem(F.regexp_replace("url", r"[?#].*$", "")).alias("stem"))


@query("""with k as (select doc_id, source || repeat(lang, (doc_id % 300)::int) as key from documents),
h as (select doc_id, key, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(key, ''), lambda c: ascii(c)::hugeint)), lambda h, c: xor(h, c) * 16777619 & 4294967295)::bigint as hash from k)
select doc_id, case when length(key) > 500 then substring(key, 1, 491) || '#' || format('{:08x}', hash) else key end as key from h""")
def cap_key(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", T.cap_key(F.concat("source", F.repeat("lang", (F.col("doc_id") % 300).cast("int")))).alias("key"))


@query(r"select p_partkey, regexp_replace(regexp_replace(printf('%.5f', p_partkey * 37 % 100000 / 1e5), '0+$', ''), '\.$', '') as score from part")
def score_format(spark, d):
    return table(spark, d, "part").select("p_partkey", T.score_text(F.col("p_partkey") * 37 % 100000 / F.lit(1e5)).alias("score"))


@query("""select event_id as query_id, 0::bigint as position, (event_id % 100) / 100e0 as rerank_score from events where event_id % 4 <> 3
union all select event_id, 1, case when event_id % 4 = 0 then 0.5 else 0 end from events where event_id % 4 in (0, 1)""")
def service_scores(spark, d):
    """Answers of scoring services: an object with results, bare lists with scores or none, and broken text."""
    e = F.col("event_id")
    s = (e % 100 / F.lit(100e0)).cast("string")
    body = F.when(e % 4 == 0, F.concat(F.lit('{"results": [{"index": 0, "relevance_score": '), s, F.lit('}, {"index": 1, "score": 0.5}]}')))
    body = body.when(e % 4 == 1, F.concat(F.lit('[{"index": 0, "score": '), s, F.lit('}, {"index": 1}]'))).when(e % 4 == 2, F.concat(F.lit('[{"index": 0, "relevance_score": '), s, F.lit("}]"))).otherwise("no answer")
    return rerank.parse_scores(table(spark, d, "events").select(e.alias("query_id"), body.alias("json")))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def newest_first(spark, d):
    return sources.newest_first(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("select doc_id, 'query: ' || text as local_query, 'passage: ' || text as local_passage, '<instruct>find' || chr(10) || '<query>' || text as hosted_query, text as hosted_passage from documents")
def embed_prefixes(spark, d):
    kinds = [(k, h) for h in (False, True) for k in ("query", "passage")]
    names = ["local_query", "local_passage", "hosted_query", "hosted_passage"]
    return table(spark, d, "documents").select("doc_id", *[tokenizers.instructed(F.col("text"), k, h, "find").alias(n) for n, (k, h) in zip(names, kinds, strict=True)])


@query("select unnest(['src/A' || page_id || '.cs', 'B' || page_id || '.cs']) as file_path from pages where page_id % 5 <> 0")
def listed_versions(spark, d):
    """Pages of a tree's listing: folders left out, paths below the root, broken pages without rows."""
    i = F.col("page_id").cast("string")
    body = F.concat(F.lit('{"value": [{"path": "$/root", "isFolder": true}, {"path": "$/root/src/A'), i, F.lit('.cs"}, {"path": "$/Root/B'), i, F.lit('.cs", "isFolder": false}]}'))
    return sources.listing(table(spark, d, "pages").select(F.when(F.col("page_id") % 5 == 0, "broken").otherwise(body).alias("json")), "versions", "$/ROOT/")


@query(f"""with r as (select 0::bigint as query_id, 'licensed apache' as text), {_FILES}, {_bm25('ff', _FILE_TEXT)}
select file_path, file_type as class_name, rank from ff join files on id = file_id where rank > 0 order by rank desc, id limit 40""")
def lexical_fallback(spark, d):
    """A question without names goes to the full text by its keywords."""
    f = files(spark, d).withColumns({"class_name": F.col("file_type"), "base_class": F.lit(""), "method_names": F.lit(""), "property_names": F.lit("")})
    return lexical.fallback_search(spark, f, "Where is the licensed, apache?", 40, text_index(spark, d, "files"))


@query(f"""with {_FILES}, x as (select *, row_number() over (partition by file_type order by file_id)::int as pos from files)
select file_type as query_id, pos, file_path as id, case when pos > 1 and length(content) > 1500 then substring(content, 1, 1500) || chr(10) || '... [truncated] ...' else content end as document, file_type as shown, '' as base_class from x where pos <= 9""")
def result_shape(spark, d):
    """What a search returns: the first nine of each language as one query, contents cut but for the first, metadata as text."""
    w = Window.partitionBy("file_type").orderBy("file_id")
    x = files(spark, d).withColumns({"pos": F.row_number().over(w), "query_id": F.col("file_type"), "base_class": F.lit(None).cast("string"), "lexical": F.lit(True), "question": F.lit("q")})
    x = rerank.shaped(rerank.rerank(x, None, n_results=9), rerank.FALLBACK_KEYS)
    return x.select("query_id", "pos", "id", "document", F.col("metadata")["file_type"].alias("shown"), F.col("metadata")["base_class"].alias("base_class"))


@query("select doc_id, source from (select doc_id, source from documents where doc_id % 5 <> 0 union all select doc_id, 'new' from documents where doc_id % 5 = 0)")
def replace_by_key(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source")
    return store.replaced(x, x.where("doc_id % 5 = 0").withColumn("source", F.lit("new")), "doc_id")


@query("select c.conv_id, c.turn from conversations c where exists (select 1 from documents where doc_id = c.conv_id and lang = 'en')")
def cascade(spark, d):
    p = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id"))
    return store.cascaded(table(spark, d, "conversations").select("conv_id", "turn"), p, "conv_id")


@query("select page_id, regexp_replace(case when lower(url) like 'https://%' then substring(url, 9) else url end, '^/+', '') as path from pages")
def relative_paths(spark, d):
    return table(spark, d, "pages").select("page_id", sources.relative(F.col("url"), "HTTPS://").alias("path"))


@query("select event_id, case when event_type = 'click' then 'UP' else 'DOWN' end as verdict, substring(trim(coalesce(props, '')), 1, 400) as question from events where event_type in ('click', 'error')")
def feedback(spark, d):
    from ..api import feedback_rows

    e = table(spark, d, "events").where("event_type in ('click', 'error')")
    return feedback_rows(e.select(F.col("event_id").alias("ts"), F.col("props").alias("question"), (F.col("event_type") == "click").alias("helpful"))).select(F.col("ts").alias("event_id"), "verdict", "question")


@query("select cast(ts as date)::varchar as day, event_type, count(*) as n from events where cast(ts as date) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by all")
def telemetry_stream_daily(spark, d):
    """The events as a stream of files, with the days that are final when it has been read; state and output lie in the shared folder."""
    root = f"{store.shared_root(spark)}/daily-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    usage_stream.append(usage_stream.daily_usage(stream), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema("day string, event_type string, n long").parquet(f"{root}/out")


@query(rf"with {_FILES}, x as (select file_id as id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', file_path, content, file_type)), '[^\p{{L}}0-9]+'), lambda t: t <> '')) as term from files), p as (select id, term, count(*) as tf from x group by all) select term, count(*) as df, sum(tf)::bigint as n from p group by term")
def fulltext_index(spark, d):
    """What the stored index of files holds on each word: documents and occurrences."""
    return text_index(spark, d, "files").postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"with {_LINES} select count(*) as n, round(avg(len(list_filter(regexp_split_to_array(lower(concat_ws(' ', content, name, class_name, namespace)), '[^\\p{{L}}0-9]+'), lambda t: t <> ''))), 6) as mean from lines")
def fulltext_stats(spark, d):
    return text_index(spark, d, "lines").stats.select("n", F.round("mean", 6).alias("mean"))


@query("select doc_id, lang from documents where lang <> 'es'")
def staging_swap(spark, d):
    """A live version, a failed build that leaves it, and a complete one that takes its place."""
    s = store.Store(spark, f"{store.shared_root(spark)}/store-{uuid.uuid4().hex}")
    x = table(spark, d, "documents").select("doc_id", "lang")
    s.promote(s.stage({"files": x}))
    for part in ("lang = 'fr'", "lang <> 'es'"):
        new = s.stage({"files": x.where(part)})
        if s.complete(new, "files", x.where("lang <> 'es'").count()):
            s.promote(new)
    return s.read("files")


@query("""with f as (select p_name || p_partkey as file_path, p_brand as class_name, case when p_size % 7 = 0 then null else p_size * 37 end as rank from part where p_partkey % 2 = 0),
v as (select p_name || p_partkey as file_path, (p_partkey * 13 % 100) / 100e0 as vector_score from part where p_partkey % 3 = 0),
b as (select coalesce(f.file_path, v.file_path) as file_path, rank, coalesce(vector_score, 0) as vector_score, case when rank is null then 100 else greatest(0e0, 100 - 5 * greatest(0e0, 20 - rank / 50.0)) end::double as text, f.file_path is null as alone from f full join v on f.file_path = v.file_path)
select file_path, coalesce(case when alone then 999 else rank end, -1)::int as rank, vector_score, round(case when alone then 50 * vector_score else text + 100 * vector_score end, 6) as score from b order by score desc, file_path limit 500""")
def path_merge(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("file_path", F.concat("p_name", k.cast("string")))
    f = p.where(k % 2 == 0).select("file_path", F.lit("").alias("class_name"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 37).alias("rank"))
    v = p.where(k % 3 == 0).select("file_path", (k * 13 % 100 / F.lit(100e0)).alias("vector_score"))
    return lexical.path_merge(f, v, "~", 500).withColumns({"score": F.round("score", 6), "rank": F.coalesce("rank", F.lit(-1))})


@query("select conv_id, coalesce(string_agg(chr(10) || '- ' || nullif(text, ''), '' order by turn), '') as listed from conversations group by conv_id")
def source_list(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", F.replace(T.source_list(F.transform("t", lambda r: r["text"])), F.lit("\n\nSources:"), F.lit("")).alias("listed"))


@query("select event_id, case when s >= 3600 then (s // 3600) || 'h ' || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm ' || lpad((s % 60)::varchar, 2, '0') || 's' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as took from (select event_id, event_id * 7 % 9000 as s from events)")
def elapsed_format(spark, d):
    return table(spark, d, "events").select("event_id", T.elapsed(F.col("event_id") * 7 % 9000).alias("took"))


@query("select vec_id, len(embedding)::int as dim, round(embedding[1]::double, 5) + 0 as first, round(embedding[-1]::double, 5) + 0 as last from embeddings")
def vector_json(spark, d):
    """Vectors as JSON text and back, with the check of their length."""
    back = T.vector_of(T.vector_json(F.col("embedding")), 64)
    x = table(spark, d, "embeddings").select("vec_id", back.alias("v"))
    return x.select("vec_id", F.size("v").alias("dim"), (F.round(F.col("v")[0].cast("double"), 5) + 0e0).alias("first"), (F.round(F.element_at("v", -1).cast("double"), 5) + 0e0).alias("last"))


@query(r"select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def json_scalar(spark, d):
    return table(spark, d, "events").select("event_id", T.json_number(F.col("props"), "$.k").alias("k"))


@query("select vec_id, '[' || array_to_string(list_transform(range(len(embedding)), lambda i: '0'), ',') || ']' as zero from embeddings")
def zero_vector(spark, d):
    return table(spark, d, "embeddings").select("vec_id", T.zero_vector(64).alias("zero"))


@query("select page_id, case when page_id % 2 = 0 then 'HTTPS://www/x' || page_id else 'https://WWW/' || ltrim(replace(url, chr(92), '/'), '/') end as path from pages")
def rooted_paths(spark, d):
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("HTTPS://www/x"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("//"), "url"))
    return table(spark, d, "pages").select("page_id", sources.rooted(p, "https://WWW").alias("path"))


@query(f"select query_id, max(rerank_score) filter (position % 4 <> 0) as observed_top from ({_SCORED}) group by query_id")
def observed_top(spark, d):
    s = _scored(spark, d)
    return usage.observed_top(s.where("position % 4 <> 0").select("query_id", "position", "rerank_score"), s.select("query_id", "position"))


@query(r"""select conv_id, turn, '2024-01-02 03:04:05|' || case when turn % 2 = 0 then 'UP' else 'DOWN' end || '|Q:' || trim(regexp_replace(text, '\s+', ' ', 'g')) || '|A:' || role as value from conversations""")
def feedback_lines(spark, d):
    c = table(spark, d, "conversations").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    rows = c.select("conv_id", "turn", "ts", F.col("text").alias("question"), F.col("role").alias("answer"), (F.col("turn") % 2 == 0).alias("helpful"))
    return rows.select("conv_id", "turn", usage.feedback_line().alias("value"))


@query("select event_id, case when user_id % 4 = 0 then case when user_id % 3 = 0 then false else true end when user_id % 4 = 1 then value > 50 else true end as supported from events")
def lexical_support(spark, d):
    u = F.col("user_id")
    source = F.when(u % 4 != 0, "Hybrid").when(u % 3 == 0, "Vector").otherwise("FullText")
    chunk, file = F.when(u % 4 == 1, "0"), F.when(u % 4 == 1, F.when(F.col("value") > 50, "0.0161").otherwise("0"))
    return table(spark, d, "events").select("event_id", rerank.lexical_support(source, chunk, file).alias("supported"))


@query("select event_id, ts, nullif(trim(user_id::varchar), '') as client_ip from events where event_type in ('view', 'click')")
def visits(spark, d):
    from ..api import visit_rows

    e = table(spark, d, "events")
    path = F.when(F.col("event_type") == "view", "/").when(F.col("event_type") == "click", "/Index.html").otherwise("/query")
    rows = e.select(F.struct("event_id", "ts").alias("ts"), F.lit("get").alias("method"), path.alias("path"), F.col("user_id").cast("string").alias("address"))
    return visit_rows(rows).select("ts.event_id", "ts.ts", "client_ip")


@query("select conv_id, turn, case when not coalesce(regexp_matches(text, '\\S'), false) or turn % 3 = 0 then true else false end as refused from conversations")
def answer_guard(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.answer_guard(F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" \n")).isNotNull().alias("refused"))


@query("select doc_id, substring(translate(text, chr(39) || chr(34) || '&|~!', '      '), 1, 4000) as safe from documents")
def safe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.safe_text(F.col("text")).alias("safe"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
