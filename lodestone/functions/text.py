"""Scalar functions over text columns; every one is a built-in expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = "what where when who how would should could create make build properties does have the for a an in on to is are show me find get exist exists see can using".split()
SQL_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "JOIN", "WHERE", "GROUP BY", "ORDER BY"]
GUARD = "warmup keepalive"
MORE_DETAIL = "Please answer in more detail: "
WORD = r"[\p{L}0-9]+"
NO_GROUNDS = "Nothing retrieved from the indexed codebase answers this question, so no answer is given."


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def safe_text(c: Column) -> Column:
    return F.substring(F.translate(c, "'\"&|~!", "      "), 1, 4000)


def keywords(c: Column) -> Column:
    """Distinct lower-case words of more than two letters that are no stop words."""
    words = F.transform(F.split(c, r"[ ,?!.'\"]+"), lambda t: F.lower(t))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS)))


def pascal_terms(c: Column) -> Column:
    """Words of at least 8 letters that begin with a capital and hold another capital and a small letter."""
    return F.filter(F.split(c, r"[ ,?!.'\"()]+"), lambda t: (F.length(t) >= 8) & t.rlike(r"^\p{Lu}") & t.rlike(r"\p{Lu}.*\p{Lu}") & t.rlike(r"\p{Ll}"))


def first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def repo_parts(c: Column) -> Column:
    """struct(owner, repo) of a repository URL, SCP form or slug; empty parts where it is none."""
    x = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"/+$", ""), r"(?i)\.git$", "")
    pattern = r"^(?:https?://[^/]+/|[^@/]+@[^:/]+:)?([^/:\s]+)/([^/:\s]+)$"
    return F.struct(F.regexp_extract(x, pattern, 1).alias("owner"), F.regexp_extract(x, pattern, 2).alias("repo"))


def client_ip(c: Column) -> Column:
    """First hop; the port goes where there is exactly one colon; at most 45 letters; blank is null."""
    hop = F.trim(F.split(c, ",")[0])
    colons = F.length(hop) - F.length(F.translate(hop, ":", ""))
    return F.nullif(F.substring(F.when(colons == 1, F.split(hop, ":")[0]).otherwise(hop), 1, 45), F.lit(""))


def author(c: Column) -> Column:
    x = F.when(F.instr(c, "<") > 1, F.trim(F.split(c, "<")[0])).otherwise(F.trim(c))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("Unknown"))


def stem(c: Column) -> Column:
    """Last path segment without its last extension."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def words_in(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != ""))


def token_estimate(c: Column) -> Column:
    return (words_in(c) * 6 / 5).cast("int")


def preview(c: Column, words: int = 42) -> Column:
    """The first words with their white space; all of it where it has no more."""
    return F.when(words_in(c) <= words, c).otherwise(F.regexp_extract(c, r"^\s*(?:\S+\s+){%d}\S+" % (words - 1), 0))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code units (code points below U+10000)."""
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), lambda h, x: F.when(x == "", h).otherwise((h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295))))


def cap_key(c: Column, most: int = 500) -> Column:
    """Keys longer than most: the first most - 9 letters, "#" and the hash in eight digits."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 9), F.lit("#"), F.lower(F.lpad(F.hex(fnv1a(c)), 8, "0")))).otherwise(c)


def truncated(c: Column, pos: Column, most: int = 1500) -> Column:
    """Long contents are cut, but for the first of a result list."""
    return F.when((pos > 0) & (F.length(c) > most), F.concat(F.substring(c, 1, most), F.lit("\n... [truncated] ..."))).otherwise(c)


def question(c: Column) -> Column:
    return F.lower(F.trim(c))


def answer_guard(context: Column) -> Column:
    """The fixed answer where nothing was retrieved, else null: the question then goes to a language model with its context."""
    return F.when(~grounded(context), F.lit(NO_GROUNDS))


def source_list(paths: Column) -> Column:
    """The block of sources below an answer; empty where no path is left."""
    kept = F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("\n\nSources:"), F.array_join(F.transform(kept, lambda p: F.concat(F.lit("\n- "), p)), "")))


def elapsed(seconds: Column) -> Column:
    """37s, 2m 18s, 1h 04m 12s."""
    s = F.floor(seconds).cast("long")
    h, m, r = (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60
    return F.when(s >= 3600, F.format_string("%dh %02dm %02ds", h, m, r)).when(s >= 60, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", s))


def json_number(doc: Column, path: str) -> Column:
    """A whole number at a JSON path; null where it is missing or none."""
    return F.get_json_object(doc, path).try_cast("int")


def zero_vector(dimension: int) -> Column:
    """The JSON text of the zero vector, as a probe of a vector index takes it."""
    return F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("0"), dimension), ","), F.lit("]"))


def vector_json(v: Column) -> Column:
    return F.to_json(v)


def vector_of(body: Column, dimension: int) -> Column:
    """The vector in a service's answer, [..] or [[..]], or {"vector": ..}; anything else, or another length, fails the query."""
    flat = lambda t: F.from_json(t, "array<float>")
    inner = F.coalesce(F.get_json_object(body, "$.vector"), body)
    v = F.when(F.regexp_like(inner, F.lit(r"^\s*\[\s*\[")), F.get(F.from_json(inner, "array<array<float>>"), F.lit(0))).otherwise(flat(inner))
    return of_dimension(F.when(v.isNull(), F.raise_error(F.concat(F.lit("no vector in the answer: "), F.coalesce(F.substring(body, 1, 200), F.lit("null"))))).otherwise(v), dimension)


def of_dimension(v: Column, dimension: int) -> Column:
    """The vector itself; one of another length fails the query, since every distance to it would be nonsense. Null stays null."""
    wrong = F.raise_error(F.format_string(f"a vector has %d components, and the index is set to {dimension}: set the dimension of the model and build the index anew", F.size(v)))
    return F.when(v.isNull() | (F.size(v) == dimension), v).otherwise(wrong)


def grounded(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def glob_regex(glob: str) -> str:
    """Regex of a path glob: ** crosses folders, * and ? stay within one."""
    out, g = "", glob.strip().replace("\\", "/").lstrip("/")
    i = 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "."}.get(g[i], re.escape(g[i])), i + 1
    return f"(?i)^{out}$"


def glob_match(path: Column, include: list[str], exclude: list[str]) -> Column:
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    any_of = lambda gs: F.array_contains(F.array(*[p.rlike(glob_regex(g)) for g in gs]), True) if gs else None
    yes, no = any_of(include), any_of(exclude)
    return (F.lit(True) if yes is None else yes) & ~(F.lit(False) if no is None else no)


def score_text(c: Column) -> Column:
    """At most five decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.5f", c), "0+$", ""), r"\.$", "")
