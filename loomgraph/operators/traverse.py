"""Traversals: bounded breadth-first search with discovery order, and unbounded closure.

A level is a join of the frontier with the edges, an anti-join with what was seen, and a minimum per
node. The edges are laid out by their near end once, for all levels. The order of a queue is that of
paths of edge places, so the least path names the edge that finds a node first, and nothing has to be
numbered globally. Each level is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut
from loomgraph.schemas import DEPENDENCIES

CALLS = ("CALLS",)
#: After so many levels what was seen is written anew, as one table.
REWRITE = 8


def adjacency(edges: DataFrame, kinds: tuple[str, ...] = DEPENDENCIES, backward: bool = False) -> DataFrame:
    here, there = ("dst", "src") if backward else ("src", "dst")
    rows = edges.filter(F.col("kind").isin(*kinds) & (F.col("dst") != ""))
    return cut(rows.select(F.col(here).alias("here"), F.col(there).alias("there"), "seq", "confidence").repartition("here"))


def reach(edges: DataFrame, starts: DataFrame, depth: int, kinds: tuple[str, ...] = CALLS, backward: bool = False) -> DataFrame:
    """root, id, distance, confidence, path for every node within ``depth`` steps of each root.

    ``starts`` has a column ``root``. Roots themselves don't come back. ``path`` sorts a root's nodes
    in order of discovery; ``confidence`` is that of the edge that found the node first.
    """
    steps = adjacency(edges, kinds, backward)
    empty = F.array().cast(f"array<{edges.schema['seq'].dataType.simpleString()}>")
    seen = starts.select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.lit("").alias("confidence"), empty.alias("path")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        found = (
            frontier.select("root", F.col("id").alias("here"), "path").join(steps.hint("merge"), "here")
            .select("root", F.col("there").alias("id"), F.concat("path", F.array("seq")).alias("path"), "confidence")
            .join(seen.select("root", "id").hint("merge"), ["root", "id"], "left_anti")
            .groupBy("root", "id").agg(F.min(F.struct("path", "confidence")).alias("first"))
        )
        frontier = cut(found.select("root", "id", F.lit(level).alias("distance"), "first.confidence", "first.path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = cut(seen) if level % REWRITE == 0 else seen
    return seen.filter("distance > 0")


def closure(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids reachable over dependency edges from ``entries`` (column id), the entries among them."""
    # Sizes that Spark expects are those of compressed files, so it would send millions of ids through the driver.
    steps, level = adjacency(edges).select(F.col("here").alias("id"), "there").hint("merge"), 0
    seen = frontier = cut(entries.select("id").distinct())
    while not frontier.isEmpty():
        frontier = cut(frontier.join(steps, "id").select(F.col("there").alias("id")).distinct().join(seen.hint("merge"), "id", "left_anti"))
        level += 1
        seen = cut(seen.union(frontier)) if level % REWRITE == 0 else seen.union(frontier)
    return seen


def described(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reached ids with their nodes' attributes; an id without a node describes itself."""
    known = nodes.select("id", "qualified_name", "kind", "file")
    rows = reached.join(known, "id", "left")
    return rows.select(
        "root", "id", F.coalesce("qualified_name", "id").alias("qualified_name"), F.coalesce("kind", F.lit("?")).alias("kind"),
        F.coalesce("file", F.lit("")).alias("file"), "distance", "confidence", "path",
    )


def callees(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return reach(edges, starts, depth)


def callers(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return reach(edges, starts, depth, backward=True)


def blast_radius(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """What depends on the roots, directly or through others."""
    return reach(edges, starts, depth, DEPENDENCIES, backward=True)


def resolve_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, id (null unless exactly one fits), candidates (the first 20, in order).

    A symbol is a qualified name, of any kind, or else the simple name of anything but a module.
    """
    exact = nodes.join(symbols, nodes["qualified_name"] == symbols["symbol"]).select("symbol", "seq", "id")
    simple = (
        nodes.filter("kind <> 'Module'").join(symbols, nodes["name"] == symbols["symbol"]).select("symbol", "seq", "id")
        .join(exact.select("symbol").distinct(), "symbol", "left_anti")
    )
    both = exact.union(simple)
    counts = both.groupBy("symbol").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("seq"))
    listed = both.withColumn("rank", rank).filter(F.col("rank") <= 20).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("listed"))
    rows = symbols.join(counts, "symbol", "left").join(listed, "symbol", "left")
    several = F.when(F.col("n") > 1, F.transform("listed", lambda c: c["id"])).otherwise(F.array().cast("array<string>"))
    return rows.select("symbol", F.when(F.col("n") == 1, F.col("one")).alias("id"), several.alias("candidates"))


def change_impact(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """Blast radius of every symbol in the files: symbol's name, file, and what it reaches.

    All symbols are roots of one traversal.
    """
    touched = nodes.filter(F.col("kind").isin("Function", "Method", "Class")).join(files.select("file").distinct(), "file", "left_semi")
    found = reach(edges, touched.select(F.col("id").alias("root")), depth, DEPENDENCIES, backward=True)
    named = touched.select(F.col("id").alias("root"), F.col("qualified_name").alias("symbol"), F.col("file").alias("symbol_file"))
    return described(found, nodes).join(named, "root")


def impact_by_file(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """file, symbol, affected: how many nodes a change to each symbol of the files reaches, none too."""
    found = change_impact(nodes, edges, files, depth).groupBy(F.col("root").alias("id")).agg(F.count("*").alias("reached"))
    touched = nodes.filter(F.col("kind").isin("Function", "Method", "Class")).join(files.select("file").distinct(), "file", "left_semi")
    return touched.join(found, "id", "left").select("file", F.col("qualified_name").alias("symbol"), "id", F.coalesce("reached", F.lit(0)).alias("affected"))
