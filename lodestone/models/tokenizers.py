"""Token ids for embedders and cross-encoders: word pieces, and pairs of sentence pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MOST, PIECE = 512, 20
PAIR_OFFSET, BEGIN, END = 1, 0, 2


def word_pieces(text: str | None, vocabulary: dict[str, int], most: int = MOST, unknown: str = "[UNK]", begin: str = "[CLS]", end: str = "[SEP]") -> list[int]:
    """Lower-case words as whole entries, else the longest known pieces of at most 20 letters.

    The rest of a word without a known piece is one unknown token. One place
    is kept for the closing token.
    """
    out = [vocabulary[begin]]
    for word in (text or "").lower().split():
        if len(out) >= most - 1:
            break
        if word in vocabulary:
            out.append(vocabulary[word])
            continue
        at = 0
        while at < len(word) and len(out) < most - 1:
            mark = "##" if at else ""
            size = next((n for n in range(min(PIECE, len(word) - at), 0, -1) if mark + word[at : at + n] in vocabulary), 0)
            out.append(vocabulary[mark + word[at : at + size]] if size else vocabulary[unknown])
            at = at + size if size else len(word)
    return out[: most - 1] + [vocabulary[end]]


def wordpiece_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int], most: int = MOST) -> DataFrame:
    """(id, ids) of every text."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_pieces(t, vocabulary, most))

    return df.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("ids"))


def pair(query: list[int], document: list[int], most: int = MOST) -> list[int]:
    """begin query end end document end; the document is cut first, and the query only where it alone is too long."""
    room = most - 4 - len(query)
    if room < 1:
        query, room = query[: max(most - 5, 1)], 1
    return [BEGIN, *query, END, END, *document[:room], END]


def pair_tokens(df: DataFrame, id_col: str, query_col: str, text_col: str, model_path: str, most: int = MOST) -> DataFrame:
    """(id, ids) of every pair; the sentence-piece model is read once a task from a path all executors see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        known: dict[str, list[int]] = {}
        for x in batches:
            known = {q: known.get(q) or [i + PAIR_OFFSET for i in model.encode(q or "")] for q in x["query"].unique()}
            ids = [pair(known[q], [i + PAIR_OFFSET for i in model.encode(t or "")], most) for q, t in zip(x["query"], x["text"], strict=True)]
            yield pd.DataFrame({"id": x["id"], "ids": ids})

    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query_col, F.lit("")).alias("query"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, "id long, ids array<int>")


def mean_pool(df: DataFrame, id_col: str, vector_col: str, mask_col: str) -> DataFrame:
    """(id, pooled): the mean of an id's token vectors whose mask is 1, by dimension; no such token: no row.

    A partial aggregate by (id, dimension), so a long text is no single task's work.
    """
    x = df.where(F.col(mask_col) == 1).select(F.col(id_col).alias("id"), F.posexplode(vector_col).alias("dim", "v"))
    g = x.groupBy("id", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return g.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda r: r["v"]).alias("pooled"))


def instructed(text: Column, kind: str, hosted: bool, task: str = "") -> Column:
    """The text an embedder reads: prefixes for a local model; an instruction before hosted queries only."""
    if not hosted:
        return F.concat(F.lit(f"{kind}: "), text)
    return F.concat(F.lit(f"<instruct>{task}\n<query>"), text) if kind == "query" else text


def hashing_embedder(dimension: int) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: signed counts of hashed words, of length one; blank text is the zero vector."""
    from ..functions.text import tokens
    from ..operators.vectors import l2_normalised

    def embed(text: Column) -> Column:
        hashes = F.transform(tokens(text), lambda w: F.xxhash64(w))
        sums = F.transform(
            F.sequence(F.lit(0), F.lit(dimension - 1)),
            lambda d: F.aggregate(hashes, F.lit(0e0), lambda s, h: s + F.when(F.pmod(h, F.lit(dimension)) == d, F.when(F.shiftright(h, 62).bitwiseAND(F.lit(1)) == 1, 1e0).otherwise(-1e0)).otherwise(0e0)),
        )
        return l2_normalised(sums)

    return embed
