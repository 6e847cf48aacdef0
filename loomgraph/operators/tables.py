"""Keyed upserts, replacements and deletions as set operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schemas import edge_key


def last_wins(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """One row per key: the values of its last row at the place (``seq``) of its first."""
    values = [c for c in rows.columns if c not in key and c != seq]
    last = F.max_by(F.struct(*values), seq).alias("last") if values else F.lit(None).alias("last")
    merged = rows.groupBy(*key).agg(F.min(seq).alias(seq), last)
    return merged.select(*[F.col(c) if c in (*key, seq) else F.col(f"last.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """``old`` with the rows of ``new``: equal keys take the new values and keep their place."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    ordered = both.withColumn("_order", F.struct("_new", seq))
    values = [c for c in old.columns if c not in key and c != seq]
    merged = ordered.groupBy(*key).agg(F.min("_order").alias("_first"), F.max_by(F.struct(*values), "_order").alias("_last"))
    return merged.select(
        *[F.col(c) if c in key else F.col(f"_first.{seq}").alias(seq) if c == seq else F.col(f"_last.{c}").alias(c) for c in old.columns]
    )


def upsert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by key, both upserted."""
    keyed = lambda rows: rows.withColumn("_key", edge_key())
    return upsert(nodes, new_nodes, ["id"]), upsert(keyed(edges), keyed(new_edges), ["_key"]).drop("_key")


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the files go, and edges that begin at one of them; edges that end there stay."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("src")).distinct()
    left = nodes.join(files.select("file").distinct(), "file", "left_anti")
    return left, edges.join(gone, "src", "left_anti")


#: Slots that keys are counted in; a slot is crowded above so many rows, and above this share of all.
SLOTS, CROWD, CROWD_SHARE = 65_536, 100_000, 1000
#: Shares of rows that need nothing.
SPREAD = 1024


def _slot(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS))


def crowded(rows: DataFrame, wanted: dict[str, tuple[list[str], Column]]) -> dict[str, list[tuple[int, int]]]:
    """By name of ``wanted`` (key, and which rows need it): the slots with many rows, and in how many shares to deal each.

    Fewer than ``CROWD_SHARE`` slots a key come to the driver, whatever the rows; they are read once, so they had better be written.
    """
    names = list(wanted)
    slots = F.array(*[F.when(needed, _slot(key) + i * SLOTS) for i, (key, needed) in enumerate(wanted.values())])
    counts = rows.select(F.explode(slots).alias("slot")).filter("slot IS NOT NULL").groupBy("slot").agg(F.count("*").alias("n"))
    counts = counts.select(F.floor(F.col("slot") / SLOTS).alias("name"), (F.col("slot") % SLOTS).alias("slot"), "n")
    most = F.greatest(F.lit(CROWD), F.col("total") / CROWD_SHARE)
    many = counts.join(F.broadcast(counts.groupBy("name").agg(F.sum("n").alias("total"))), "name").filter(F.col("n") > most)
    found = {name: [] for name in wanted}
    for r in many.select("name", "slot", F.ceil(F.col("n") / most).alias("shares")).collect():
        found[names[r["name"]]].append((r["slot"], r["shares"]))
    return found


def look_up(rows: DataFrame, table: DataFrame, key: list[str], needed: Column, crowds: list[tuple[int, int]], place: tuple[str, ...] = ("src", "seq")) -> DataFrame:
    """``rows`` (told apart by ``place``) left-joined by shuffle with ``table`` (unique on ``key``), where ``needed``; null elsewhere.

    Rows that need nothing are spread, those of a crowded slot (``crowded``) dealt to as many shares, each with its copy of the slot's keys.
    """
    others, place, copies = rows.columns, F.xxhash64(*place), F.lit(1)
    if crowds:
        shares = F.broadcast(rows.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).cast("long").alias("_slot"), F.lit(n).alias("_shares")) for s, n in crowds]))))
        rows, table = (t.withColumn("_slot", _slot(key)).join(shares, "_slot", "left").drop("_slot") for t in (rows, table))
        copies = F.coalesce("_shares", F.lit(1))
    rows = rows.withColumn("_share", F.when(needed, F.pmod(place, copies)).otherwise(-1 - F.pmod(place, F.lit(SPREAD))))
    table = table.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), copies - F.lit(1).cast("long"))) if crowds else F.lit(0).cast("long"))
    values = [c for c in table.columns if c not in (*key, "_share", "_shares")]
    return rows.join(table.select(*key, "_share", *values).hint("merge"), [*key, "_share"], "left").select(*others, *values)


def find(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal the values given; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def search(nodes: DataFrame, text: str | None) -> DataFrame:
    """Nodes whose name or qualified name contains the text, whatever its case."""
    if not text:
        return nodes
    return nodes.filter(F.lower("name").contains(text.lower()) | F.lower("qualified_name").contains(text.lower()))


def next_id(rows: DataFrame, column: str = "id") -> Column | DataFrame:
    return rows.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def latest(rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(column)).limit(1)
