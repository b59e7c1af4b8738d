"""Connected components of link tables, in one array and over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import settle


def roots(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of n, by links a[i] - b[i]; labels: an earlier result to go on from."""
    lab = np.arange(n) if labels is None else labels
    while True:
        la, lb = lab[a], lab[b]
        m = la != lb
        if not m.any():
            return lab
        a, b, la, lb = a[m], b[m], la[m], lb[m]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(lab, up := lab[lab]):
            lab = up


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: src, dst (bigint, no nulls). Returns node, root for every node with a link, root: its smallest node.

    Alternates large-star and small-star steps; minima are grouped aggregates with partial sums, so a hub costs no
    list, and every step is checkpointed. The number of steps grows with the logarithm of the largest component.
    """
    e = settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    was = None
    for _ in range(most):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(m, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = settle(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components are not done after {most} steps")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct())
