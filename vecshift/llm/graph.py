"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (child, parent) with child > parent -> (child, root): the smallest id reachable, for every child.

    Each round gives every node its smallest parent and hangs the other parents below that one; the set of edges
    only shrinks and its endpoints only fall, so the rounds end when every node has one parent. Pointer doubling then
    finds the roots. No table is collected; joins are plain equi-joins of written tables, so that skewed keys can be
    split at run time. An empty edge list gives an empty result.
    """
    e = materialize(edges.where("child > parent").distinct(), "edges")
    left = e.count()
    while True:
        low = materialize(e.groupBy("child").agg(F.min("parent").alias("low")), "low", left)
        nodes = low.count()
        if nodes == left:
            break
        moved = e.join(low, "child").where("parent > low").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        e = materialize(low.select("child", F.col("low").alias("parent")).unionByName(moved).distinct(), "edges", left)
        left = e.count()
    up = low.withColumnRenamed("low", "root")
    while True:
        above = up.select(F.col("child").alias("root"), F.col("root").alias("__top"))
        up = materialize(up.join(above, "root", "left").select("child", F.coalesce("__top", "root").alias("root"), F.col("__top").isNotNull().alias("__moved")), "up", nodes)
        if up.where("__moved").limit(1).count() == 0:
            return up.drop("__moved")
        up = up.drop("__moved")


def smallest_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (cid, rep) and links between cids -> (cid, component_id): the smallest rep of each component."""
    roots = components(edges).withColumnRenamed("child", "cid")
    inside = materialize(nodes.select("cid", "rep").join(roots, "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root")), "rooted")
    linked = inside.where("root <> cid").select("root").distinct()
    low = inside.join(linked, "root", "left_semi").groupBy("root").agg(F.min("rep").alias("low"))
    return inside.join(materialize(low, "lowest", roots.count()), "root", "left").select("cid", F.coalesce("low", "rep").alias("component_id"))


def forest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of local links a[i]-b[i] between rows 0..n-1: (child, parent) ids, the parent being the smallest
    id of the local component. Vectorised min-label propagation with pointer jumping."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    x, y = rank[a], rank[b]
    label = np.arange(n)
    while True:
        old = label
        label = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, old[x], low)
        np.minimum.at(label, old[y], low)
        label = label[label]
        if (label == old).all():
            break
    kids = np.flatnonzero(label != np.arange(n))
    return ids[order][kids], ids[order][label[kids]]
