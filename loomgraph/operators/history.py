"""Versions: differences of node tables, change log, document ledger and reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions.scalar import accepted, basename

# Details of a modification.
MOVED, CHANGED = "movida", "firma/cuerpo cambiado"


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """node_id, change (added, modified, removed), detail, and ``seq`` that orders them.

    New nodes in their order, then the removed ones in theirs. A node is modified if its body or its
    file differs; repeated ids count with their last row.
    """
    state = lambda rows, side: rows.groupBy("id").agg(
        F.max_by(F.struct("body_hash", "file"), "seq").alias(side), F.min("seq").alias(f"{side}_seq")
    )
    rows = state(old, "old").join(state(new, "new"), "id", "full_outer")
    moved = F.col("old.file") != F.col("new.file")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(moved | (F.col("old.body_hash") != F.col("new.body_hash")), "modified")
    )
    detail = F.when(F.col("change") == "modified", F.when(moved, MOVED).otherwise(CHANGED)).otherwise("")
    order = F.struct((F.col("change") == "removed").alias("last"), F.coalesce("new_seq", "old_seq").alias("at"))
    return rows.withColumn("change", change).filter("change IS NOT NULL").select(F.col("id").alias("node_id"), "change", detail.alias("detail"), order.alias("seq"))


def change_records(diffs: DataFrame, snapshot_id: int | Column) -> DataFrame:
    snapshot = snapshot_id if isinstance(snapshot_id, Column) else F.lit(snapshot_id)
    return diffs.select(snapshot.cast("int").alias("snapshot_id"), "node_id", "change", "detail")


def changes_between(changes: DataFrame, a: int, b: int) -> DataFrame:
    """Changes after the earlier snapshot up to the later one."""
    return changes.filter((F.col("snapshot_id") > min(a, b)) & (F.col("snapshot_id") <= max(a, b)))


def summary(diffs: DataFrame) -> DataFrame:
    """One row: how many were added, modified and removed."""
    return diffs.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "removed")])


# ---- documents, known by the last part of their path


def document_nodes(docs: DataFrame) -> DataFrame:
    """Ledger rows of (path, digest, seq): of equal basenames the last one counts."""
    rows = docs.groupBy(basename(F.col("path")).alias("name")).agg(F.max_by("digest", "seq").alias("body_hash"), F.min("seq").alias("seq"))
    return rows.select(F.concat(F.lit("Document:"), "name").alias("id"), "name", F.col("name").alias("file"), "body_hash", "seq")


def commit(ledger: DataFrame, docs: DataFrame, applied: DataFrame) -> DataFrame:
    """The ledger after the changes whose node_id is in ``applied``; others wait for another try."""
    new = document_nodes(docs)
    done = applied.select(F.col("node_id").alias("id")).distinct()
    changed = diff_nodes(ledger, new).select(F.col("node_id").alias("id"), "change").join(done, "id", "left_semi")
    kept = ledger.join(changed, "id", "left_anti")
    return kept.unionByName(new.join(changed.filter("change <> 'removed'"), "id", "left_semi"))


def duplicate_names(paths: DataFrame) -> DataFrame:
    """Basenames of more than one path."""
    return paths.groupBy(basename(F.col("path")).alias("name")).count().filter("count > 1").select("name").orderBy("name")


LEDGER = "id string, name string, file string, body_hash string, seq long"


class Ledger(NamedTuple):
    """Documents on record (``LEDGER``), snapshots and changes."""

    nodes: DataFrame
    snapshots: DataFrame
    changes: DataFrame


def empty_ledger(spark: SparkSession) -> Ledger:
    return Ledger(*[spark.createDataFrame([], schema) for schema in (LEDGER, schemas.SNAPSHOT, schemas.CHANGE)])


def _next(ledger: Ledger, nodes: DataFrame, diffs: DataFrame, metadata: dict[str, str] | None, unless_empty: bool = False) -> Ledger:
    """The ledger with ``nodes``, a snapshot and its changes; no snapshot of no changes if ``unless_empty``."""
    number = ledger.snapshots.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id"))
    if unless_empty:
        number = number.join(diffs.limit(1), how="left_semi")
    literals = [F.lit((metadata or {}).get(c, "")).alias(c) for c in ("commit_sha", "commit_time", "branch", "created_at")]
    # Single rows on the other side of both joins.
    snapshot = number.crossJoin(nodes.agg(F.count("*").alias("node_count"))).select("id", *literals, "node_count", F.lit(0).cast("long").alias("edge_count"))
    changes = change_records(diffs.crossJoin(F.broadcast(number)), F.col("id"))
    return Ledger(nodes, ledger.snapshots.unionByName(snapshot), ledger.changes.unionByName(changes))


def record(ledger: Ledger, docs: DataFrame, applied: DataFrame | None = None, metadata: dict[str, str] | None = None) -> Ledger:
    """Commit a batch of (path, digest, seq): all changes, or those whose node_id is in ``applied``."""
    diffs = diff_nodes(ledger.nodes, document_nodes(docs))
    if applied is not None:
        diffs = diffs.join(applied.select("node_id").distinct(), "node_id", "left_semi")
    return _next(ledger, commit(ledger.nodes, docs, diffs), diffs, metadata)


def record_one(ledger: Ledger, path: str, digest: str, metadata: dict[str, str] | None = None) -> Ledger:
    """One document added or modified; a snapshot is written even if nothing changed."""
    spark = ledger.nodes.sparkSession
    new = document_nodes(spark.createDataFrame([(path, digest, 0)], "path string, digest string, seq long"))
    old = ledger.nodes.join(new.select("file"), "file", "left_semi").select(*ledger.nodes.columns)
    at = ledger.nodes.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
    placed = new.drop("seq").crossJoin(at).select(*ledger.nodes.columns)  # single rows
    nodes = ledger.nodes.join(new.select("file"), "file", "left_anti").select(*ledger.nodes.columns).unionByName(placed)
    return _next(ledger, nodes, diff_nodes(old, new), metadata)


def remove_one(ledger: Ledger, path: str, metadata: dict[str, str] | None = None) -> Ledger:
    """One document gone; of a document that isn't on record nothing changes, and there is no snapshot."""
    own = F.col("file") == basename(F.lit(path))
    diffs = diff_nodes(ledger.nodes.filter(own), ledger.nodes.limit(0))
    return _next(ledger, ledger.nodes.filter(~own), diffs, metadata, unless_empty=True)


def digest_of(ledger: Ledger, path: str) -> DataFrame:
    """The digest on record of a document, by the last part of its path; no row if there is none."""
    return ledger.nodes.filter(F.col("file") == basename(F.lit(path))).select("file", "body_hash")


def history_of(ledger: Ledger, path: str) -> DataFrame:
    """Snapshots in which a document changed, in order."""
    own = F.concat(F.lit("Document:"), basename(F.lit(path)))
    return ledger.changes.filter(F.col("node_id") == own).select("snapshot_id", "change", "detail").orderBy("snapshot_id")


def sync_folder(ledger: Ledger, files: DataFrame, apply: Callable[[DataFrame], DataFrame], metadata: dict[str, str] | None = None) -> tuple[Ledger, DataFrame]:
    """Documents of a folder (path, content) against the ledger: what differs is applied, successes are committed.

    ``apply`` gets the differences (node_id, change, detail) and gives node_id and ``message`` for
    each; of paths with one name the last in order counts, and of rows with one path the first by
    ``seq``, a column that only files with repeated paths need. What isn't accepted stays as it was on
    record, for another try. Also returns one row: files, added, modified, removed, errors, and the
    names that several paths share.
    """
    place = F.struct(F.split("path", "/"), -F.col("seq")) if "seq" in files.columns else F.split("path", "/")
    last = F.max_by(F.struct("path", F.md5("content").alias("digest")), place).alias("last")
    docs = files.groupBy(basename(F.col("path"))).agg(last).select("last.*", F.lit(0).cast("long").alias("seq"))
    diffs = diff_nodes(ledger.nodes, document_nodes(docs))
    answers = apply(diffs.select("node_id", "change", "detail")).groupBy("node_id").agg(F.max(accepted(F.col("message"))).alias("ok"))
    judged = diffs.select("node_id", "change").join(answers, "node_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    counts = [F.count_if((F.col("change") == c) & F.col("ok")).alias(c) for c in ("added", "modified", "removed")]
    names = duplicate_names(files).agg(F.sort_array(F.collect_list("name")).alias("duplicates"))
    summary = files.agg(F.count("*").alias("files")).crossJoin(judged.agg(*counts, F.count_if(~F.col("ok")).alias("errors"))).crossJoin(names)
    return record(ledger, docs, judged.filter("ok"), metadata), summary


def document_state(ledger: Ledger) -> DataFrame:
    """One row: documents on record, and the last snapshot (null before the first)."""
    last = ledger.snapshots.agg(F.max_by(F.struct(*ledger.snapshots.columns), "id").alias("last_snapshot"))
    return ledger.nodes.agg(F.count("*").alias("documents")).crossJoin(last)


# ---- stores that should hold the same documents


def drift(expected: DataFrame, in_graph: DataFrame, in_vector: DataFrame) -> DataFrame:
    """drift_kind, doc_id: what either store lacks, and what it has that isn't expected."""
    expected, graph, vector = (t.select("doc_id").filter("doc_id IS NOT NULL").distinct() for t in (expected, in_graph, in_vector))
    parts = {
        "missing_in_graph": (expected, graph), "missing_in_vector": (expected, vector),
        "orphan_in_graph": (graph, expected), "orphan_in_vector": (vector, expected),
    }
    found = [a.join(b, "doc_id", "left_anti").select(F.lit(kind).alias("drift_kind"), "doc_id") for kind, (a, b) in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def drift_summary(found: DataFrame) -> DataFrame:
    kinds = ("missing_in_graph", "missing_in_vector", "orphan_in_graph", "orphan_in_vector")
    counts = [F.count_if(F.col("drift_kind") == k).alias(k) for k in kinds]
    return found.agg(*counts, (F.count("*") == 0).alias("is_aligned"))


def repair_plan(found: DataFrame) -> DataFrame:
    """kind_rank, kind, doc_id: one reindex for whatever is missing anywhere, then the orphans."""
    action = (
        F.when(F.col("drift_kind").startswith("missing"), F.struct(F.lit(0).alias("kind_rank"), F.lit("reindex").alias("kind")))
        .when(F.col("drift_kind") == "orphan_in_graph", F.struct(F.lit(1).alias("kind_rank"), F.lit("delete_orphan_graph").alias("kind")))
        .otherwise(F.struct(F.lit(2).alias("kind_rank"), F.lit("delete_orphan_vector").alias("kind")))
    )
    return found.select(action.alias("a"), "doc_id").select("a.*", "doc_id").distinct().orderBy("kind_rank", "doc_id")


def reconciled(plan: DataFrame, in_graph: DataFrame, in_vector: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both stores (doc_id) after the actions of a repair plan; applied again it changes nothing."""
    again = plan.filter("kind = 'reindex'").select("doc_id")

    def after(store: DataFrame, action: str) -> DataFrame:
        gone = plan.filter(F.col("kind") == action).select("doc_id")
        return store.select("doc_id").join(gone, "doc_id", "left_anti").union(again).distinct()

    return after(in_graph, "delete_orphan_graph"), after(in_vector, "delete_orphan_vector")
