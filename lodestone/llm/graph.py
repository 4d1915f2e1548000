"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a small edge list and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        nodes, root = local_roots(x.u.to_numpy(), x.v.to_numpy())
        keep = nodes != root
        yield pd.DataFrame({"u": nodes[keep], "v": root[keep]})


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node reachable; isolated nodes are absent.

    Large-star and small-star steps (Kiveris et al. 2014) as partial
    aggregates and equi-joins, so the neighbours of one busy node never have
    to meet in a task. Rounds go on until no edge changes. Null ends and self
    loops are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    cur = scratch.keep(e.mapInPandas(_contract, "u long, v long").distinct(), "edges")
    state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = scratch.keep(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        cur = new
        if now == state:
            break
        state = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
