"""Connected components of a graph of any size by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _minimum(edges: DataFrame, node: str, other: str) -> DataFrame:
    """The smallest neighbour (or the node itself) of every node: aggregated before the shuffle, so hubs stay small."""
    return edges.groupBy(F.col(node).alias("__n")).agg(F.least(F.min(other), F.col("__n")).alias("__m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both, "u", "v")
    return both.filter("v > u").join(least, F.col("u") == F.col("__n")).select(F.col("v").alias("u"), F.col("__m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges has u > v throughout."""
    least = _minimum(edges, "u", "v")
    linked = edges.join(least, F.col("u") == F.col("__n")).select(F.col("v").alias("u"), F.col("__m").alias("v"))
    return linked.unionByName(least.select(F.col("__n").alias("u"), F.col("__m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node on an edge (u, v); component is the smallest node that it reaches.

    Loops, repeated and reversed edges change nothing. Each round is checkpointed; hubs are dealt with by partial
    aggregation and, in joins, by the skew handling of adaptive execution.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges, state = checkpoint(edges), None
    for _ in range(rounds):
        edges = checkpoint(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_forest(n: int, links) -> np.ndarray:
    """Smallest member of the component of each of n nodes, from (i, array of linked nodes) pairs."""
    label = np.arange(n)
    for i, others in links:
        seen = label[others]
        least = min(int(seen.min()), int(label[i]))
        if label[i] != least or (seen != least).any():
            merged = np.zeros(n, bool)
            merged[seen] = True
            merged[label[i]] = True
            label[merged[label]] = least
    return label


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) of the graph with edges a[i]-b[i], without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (label[i] != label[j]).any():
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[own], nodes[label[own]]])
