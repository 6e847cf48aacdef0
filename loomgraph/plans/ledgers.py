"""The document ledger on disk: each batch is a version of its store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import history
from loomgraph.operators.history import Ledger
from loomgraph.plans import store

_SCHEMAS = {"nodes": history.LEDGER, "snapshots": schemas.SNAPSHOT, "changes": schemas.CHANGE}


def load(spark: SparkSession, folder: str, number: int | None = None) -> tuple[Ledger, int]:
    """The ledger as of a version (the last one), and the version's number; an empty one, 0, before the first."""
    version = store.read_version(spark, folder, number)
    if version is None:
        return history.empty_ledger(spark), 0
    return Ledger(*[store.read_parts(spark, version.tables[name], schema) for name, schema in _SCHEMAS.items()]), version.number


def save(ledger: Ledger, folder: str, base: int) -> int:
    """Commit ``ledger``, which came of version ``base``, as the next one; snapshots and changes are appended."""
    spark = ledger.nodes.sparkSession
    old = store.read_version(spark, folder, base) if base else None
    tables = {"nodes": store.write_parts(ledger.nodes, folder, "nodes")}
    last = 0
    if old is not None:
        last = store.read_parts(spark, old.tables["snapshots"], schemas.SNAPSHOT).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    for name, id_ in (("snapshots", "id"), ("changes", "snapshot_id")):
        new = store.write_parts(getattr(ledger, name).filter(F.col(id_) > last), folder, name)
        tables[name] = store.appended(old.tables[name] if old else {}, new)
    store.commit(spark, folder, store.Version(base + 1, tables, 1))
    return base + 1


def update(spark: SparkSession, folder: str, change: Callable[[Ledger], Ledger], tries: int = 5) -> int:
    """Apply ``change`` to the ledger of ``folder`` and commit; if another writer was first, to what it left."""
    for left in range(tries, 0, -1):
        ledger, number = load(spark, folder)
        try:
            return save(change(ledger), folder, number)
        except store.Conflict:
            if left == 1:
                raise
    raise AssertionError("not reached")


def as_of(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Documents on record at a version."""
    return load(spark, folder, number)[0].nodes
