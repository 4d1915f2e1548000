"""Queries of this subpackage, with their production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, token_files
from .bpe import default_vocabulary
from .bpe_codec import bpe_codec
from .decontaminate import leaks
from .embedding_dedup import embedding_dedup
from .license_scan import TEMPLATES, license_scan
from .line_dedup import line_dedup
from .ngram_jaccard import ngram_jaccard
from .token_counts import length_table, token_lengths
from .url_filter import url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=8, share=0.5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_codec(_table(spark, sf_dir, "documents"), default_vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(token_lengths(_table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark, _table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, _table(spark, sf_dir, "embeddings"), threshold=0.95)


# (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark, _table(spark, sf_dir, "documents"), size=3)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.read_token_files(spark, token_files.write_token_files(spark, _table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"), end_id=2))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(spark, docs, language_id.train(spark, docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_license_scan, op3_bpe, op4_token_counts, op5_ngram_jaccard, op6_embedding_dedup, op7_url_filter, op8_line_dedup, op9_token_files, op10_language_id)}


_COMPONENTS = """reach as (select distinct a as node, a as seen from links union select r.node, l.b from reach r join links l on r.seen = l.a),
root as (select node, min(seen) as root from reach group by node)"""

# Exact sets, all pairs that share a shingle, and reachability; documents of one id would need a node of their own.
_OP5 = rf"""with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from d),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from p where 100 * c >= 90 * (na + nb - c)),
{_COMPONENTS}
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(root, doc_id)) as component_id from s left join root on doc_id = node"""

_OP6 = f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
n as (select a, count(*) as n_links from links group by a),
{_COMPONENTS}
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(root, vec_id)) as component_id, least(vec_id, coalesce(root, vec_id)) = vec_id as kept from embeddings left join n on vec_id = a left join root on vec_id = node"""

_OP8 = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
k as (select doc_id, i, x, row_number() over (partition by doc_id order by i) - 1 as pos from (select doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as x from l) where x <> ''),
w as (select doc_id, pos, x, lead(x, 1) over v as y, lead(x, 2) over v as z from k window v as (partition by doc_id order by pos)),
f as (select doc_id, pos, row_number() over o as n, first_value(doc_id) over o as fd, first_value(pos) over o as fp from w where z is not null window o as (partition by x, y, z order by doc_id, pos)),
c as (select distinct f.doc_id, k.i from f join k on f.doc_id = k.doc_id and k.pos between f.pos and f.pos + 2 where n > 1 and not (f.doc_id = fd and k.pos < fp + 3)),
g as (select l.doc_id, count(*) as n_lines, count(c.i) as n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (c.i is null), '') as text from l left join c on l.doc_id = c.doc_id and l.i = c.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when d.text is not null then sha256(g.text) end as text_sha256 from documents d left join g using (doc_id)"""


def _op2() -> str:
    """Every window of every document against every template, without bands."""
    rows = [(name, text) for name, texts in sorted(TEMPLATES.items()) for text in texts]
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(rows))
    words = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^A-Za-z0-9\x{80}-\x{10FFFF}]+'), lambda w: w <> '')"
    shingles = "list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))"
    return f"""with t as (select i, license, {words} as w from (values {values}) as v(i, license, text)),
ts as (select i, license, (2 ** greatest(3, ceil(log2(len(w)))))::bigint as m, unnest(list_distinct({shingles})) as g from t),
tn as (select i, count(*) as size from ts group by i),
d as (select doc_id, {words} as w from documents),
x as (select doc_id, unnest({shingles}) as g, generate_subscripts({shingles}, 1) - 1 as p from d where len(w) >= 5),
h as (select doc_id, i, license, m, p, g from x join ts using (g)),
k as (select *, p // m as k from h union all select *, p // m - 1 as k from h where p >= m),
c as (select doc_id, license, count(distinct g) / max(size) as containment, min(p) as first_word, max(p) + 5 as end_word from k join tn using (i) where p + 5 <= (k + 2) * m group by doc_id, i, license, m, k)
select doc_id, license, x.containment as containment, first_word, x.end_word as end_word from (select doc_id, license, first_word, max({{'containment': containment, 'end_word': end_word}}) as x from c where containment >= 0.8 group by all)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2(), "op5_ngram_jaccard": _OP5, "op6_embedding_dedup": _OP6, "op8_line_dedup": _OP8}
