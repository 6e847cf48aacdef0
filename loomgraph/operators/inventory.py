"""Which symbols are reusable, mandatory or dead, and what stands out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.tables import last_wins
from loomgraph.operators.traverse import closure
from loomgraph.schemas import is_dependency, is_public, is_symbol

#: Labels that set a flag rather than being shown.
FLAGS = ("reusable", "mandatory", "keep")


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in (dependency edges, each key once), fan_in_modules (modules of known sources), call_in."""
    modules = nodes.filter("kind = 'Module'").groupBy("file").agg(F.max_by("qualified_name", "seq").alias("module"))
    sources = nodes.join(modules, "file", "left").select(F.col("id").alias("src"), F.coalesce("module", "file").alias("module"))
    rows = edges.filter(is_dependency()).select("src", "kind", "dst").distinct().join(sources.hint("merge"), "src", "left")
    return rows.groupBy(F.col("dst").alias("id")).agg(
        F.count("*").alias("fan_in"), F.countDistinct("module").alias("fan_in_modules"), F.count_if(F.col("kind") == "CALLS").alias("call_in")
    )


def annotation_maps(annotations: DataFrame) -> DataFrame:
    """id, annotations (label to note), and the other labels in order of ``seq``; of equal labels the last counts."""
    grouped = last_wins(annotations, ["node_id", "label"]).groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "label", "note"))).alias("rows"))
    return grouped.select(
        "id",
        F.map_from_entries(F.transform("rows", lambda r: F.struct(r["label"], r["note"]))).alias("annotations"),
        F.filter(F.transform("rows", lambda r: r["label"]), lambda c: ~c.isin(*FLAGS)).alias("others"),
    )


def build(nodes: DataFrame, edges: DataFrame, annotations: DataFrame, entrypoints: tuple[str, ...] = (), reusable_modules: int = 2) -> DataFrame:
    """One row per symbol: counts, the three flags, labels and annotations.

    ``nodes`` have unique ids. Entry points are named, whatever their case; ``main`` always is one.
    """
    names = {"main", *(e.lower() for e in entrypoints)}
    symbols = nodes.filter(is_symbol())
    live = closure(edges, symbols.filter(F.lower("name").isin(*names)).select("id")).withColumn("reached", F.lit(True))
    # As many rows as there are nodes: joined by shuffle, however small their files are.
    rows = symbols
    for more in (fan_in(nodes, edges), annotation_maps(annotations), live):
        rows = rows.join(more.hint("merge"), "id", "left")
    zero = F.lit(0)
    noted = lambda label: F.coalesce(F.map_contains_key("annotations", label), F.lit(False))
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("fan_in", "fan_in_modules", "call_in")})
    rows = rows.withColumn("reusable", ((F.col("fan_in_modules") >= reusable_modules) & is_public()) | noted("reusable"))
    rows = rows.withColumn("mandatory", F.col("reached").isNotNull() | noted("mandatory"))
    rows = rows.withColumn("dead", (F.col("call_in") == 0) & ~F.col("mandatory") & is_public() & ~noted("keep"))
    own = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("reusable", "mandatory", "dead")]))
    no_notes = F.create_map().cast("map<string,string>")
    return rows.select(
        "id", "qualified_name", "kind", "lang", "file", "name", "seq", "fan_in", "fan_in_modules", "reusable", "mandatory", "dead",
        F.concat(own, F.coalesce("others", F.array().cast("array<string>"))).alias("labels"),
        F.coalesce("annotations", no_notes).alias("annotations"),
    )


def annotations_of(annotations: DataFrame, node: str | None = None) -> DataFrame:
    """node_id, label, note of one node, or of all."""
    rows = annotations if node is None else annotations.filter(F.col("node_id") == node)
    return last_wins(rows, ["node_id", "label"]).select("node_id", "label", "note")


def matching(inventory: DataFrame, text: str = "") -> DataFrame:
    """A flag's name keeps the symbols that have it; other text is looked for in qualified names."""
    text = text.strip().lower()
    if text in ("reusable", "mandatory", "dead"):
        return inventory.filter(text)
    return inventory.filter(F.lower("qualified_name").contains(text)) if text else inventory


def hotspots(inventory: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` symbols that most depend on; of equal ones the first."""
    return inventory.orderBy(F.desc("fan_in"), "seq").limit(n)


def overview(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """metric, name, value: nodes by language, modules, symbols, and symbols by flag."""
    langs = nodes.groupBy("lang").count().select(F.lit("lang").alias("metric"), F.col("lang").alias("name"), F.col("count").alias("value"))
    totals = nodes.agg(F.count_if(F.col("kind") == "Module").alias("modules"), F.count_if(is_symbol()).alias("symbols"))
    flags = inventory.agg(*[F.count_if(c).alias(c) for c in ("reusable", "mandatory", "dead")])
    unpivoted = totals.unpivot([], ["modules", "symbols"], "name", "value").unionByName(flags.unpivot([], ["reusable", "mandatory", "dead"], "name", "value"))
    return langs.unionByName(unpivoted.select(F.lit("total").alias("metric"), "name", "value"))
