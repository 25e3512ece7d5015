"""Connected components of links that Spark holds: alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 with links a-b, the least node that each one reaches."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of links that span every component, lightest first: each part takes its lightest way out, again and again."""
    rank = np.empty(len(a), np.int64)
    by = np.argsort(weight, kind="stable")
    rank[by] = np.arange(len(a))
    root, taken = np.arange(n), []
    left = np.arange(len(a))
    while len(left):
        x, y = root[a[left]], root[b[left]]
        out = x != y
        left, x, y = left[out], x[out], y[out]
        if not len(left):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, x, rank[left])
        np.minimum.at(best, y, rank[left])
        new = by[np.unique(best[best < len(a)])]
        taken.append(new)
        root = local_roots(n, np.concatenate([root[a[new]], np.arange(n)]), np.concatenate([root[b[new]], root]))
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def component_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node it reaches.

    Each round links all larger neighbours of a node, then all smaller ones, to the least of them; rounds
    needed grow as the logarithm of the nodes. Only minima are gathered per node, never lists, so a node
    with very many links is summed before the shuffle and its join side can be split. Null ends and loops
    are ignored; repeated links count once.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.filter("a <> b").distinct(), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
