"""Embedders and scorers behind HTTP, as column functions: Arrow batches in the tasks, with retries while a service wakes up."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.http import warm_post

Post = Callable[[str, dict, dict[str, str]], str]


def _post(url: str, payload: dict, headers: dict[str, str]) -> str:
    return warm_post(url, payload, headers)


def vector(body: str, dimension: int) -> np.ndarray:
    """The unit vector of an answer [..], [[..]] or {"vector": ..}; anything else, or another length, is an error."""
    found = json.loads(body)
    found = found.get("vector") if isinstance(found, dict) else found
    found = found[0] if isinstance(found, list) and found and isinstance(found[0], list) else found
    if not isinstance(found, list) or len(found) != dimension:
        raise ValueError(f"not a vector of {dimension} components: {body[:200]}")
    v = np.array(found, np.float64)
    n = np.linalg.norm(v)
    return v / n if n else v


def hosted_embedder(url: str, dimension: int, token: str = "", post: Post = _post) -> Callable[[Column], Column]:
    """Unit vectors of a service, one request for each distinct text of a batch; blank text is the zero vector."""
    headers = {"Authorization": f"Bearer {token}"} if token else {}

    @F.pandas_udf("array<double>")
    def ask(texts: pd.Series) -> pd.Series:
        known = {t: vector(post(url, {"inputs": t}, headers), dimension) for t in texts.dropna().unique() if t.strip()}
        return texts.map(lambda t: known.get(t, np.zeros(dimension)))

    return lambda text: ask(text)


def scores_of(body: str, n: int) -> list[float | None]:
    """Scores by position from a list of {index, score | relevance_score}, or an object with "results"; places without one are null."""
    out: list[float | None] = [None] * n
    try:
        rows = json.loads(body)
    except ValueError:
        return out
    rows = rows.get("results", []) if isinstance(rows, dict) else rows
    for r in rows if isinstance(rows, list) else []:
        i = r.get("index") if isinstance(r, dict) else None
        if isinstance(i, int) and 0 <= i < n:
            out[i] = float(r.get("relevance_score", r.get("score", 0.0)))
    return out


def hosted_scorer(url: str, shape: str = "documents", wrap: Callable[[str, str], tuple[str, str]] | None = None, token: str = "", post: Post = _post) -> Callable[[Column, Column], Column]:
    """Scores of (question, content) pairs from a service; shape names the list in the request: "documents" or "texts".

    wrap puts both in the model's own template. Pairs of one question in a
    batch are one request. A service that fails gives nulls, so the caller's
    order stays.
    """
    headers = {"Authorization": f"Bearer {token}"} if token else {}

    @F.pandas_udf("double")
    def score(questions: pd.Series, contents: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(questions), index=questions.index, dtype="float64")
        for q, rows in contents.fillna("").groupby(questions.fillna("")):
            pairs = [wrap(q, c) if wrap else (q, c) for c in rows]
            try:
                body = post(url, {"query": pairs[0][0], shape: [c for _, c in pairs]}, headers)
            except OSError:
                continue
            out[rows.index] = scores_of(body, len(rows))
        return out

    return lambda question, content: score(question, content)


def logistic(logit: Column) -> Column:
    """A raw logit as a score between 0 and 1, so that the gate's floors hold for local cross-encoders too."""
    return 1e0 / (1e0 + F.exp(-logit))


def onnx_scorer(path: str, encode: Callable[[list[tuple[str, str]]], dict]) -> Callable[[Column, Column], Column]:
    """Scores of a cross-encoder file that all executors can read; encode makes its padded inputs of a batch of pairs."""

    @F.pandas_udf("double")
    def score(questions: pd.Series, contents: pd.Series) -> pd.Series:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        logits = session.run(None, encode(list(zip(questions.fillna(""), contents.fillna(""), strict=True))))[0]
        return pd.Series(logits[:, 0], dtype="float64")

    return lambda question, content: logistic(score(question, content))
