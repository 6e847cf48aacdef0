"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import join_counted, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``); root is the smallest node.

    Each round joins every node's links with the least neighbour (partial minima first; hubs by a bounded
    broadcast, where their links lie), writes the links below the shared folder, and ends when their count
    and hash stand still.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while not now.isEmpty():
        now = saved(_small_star(_large_star(now)), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ids = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(ids)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to its least neighbour (or itself)."""
    both = edges.union(edges.select("b", "a"))
    least = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
    return join_counted(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the least of them."""
    edges = saved(edges, "links")
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = join_counted(edges, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what ``a``-``b`` connect, of ``n`` nodes."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while not np.array_equal(again := root[root], root):
            root = again
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]
