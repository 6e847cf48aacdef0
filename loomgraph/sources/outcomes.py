"""A sink that applies changes to a store outside Spark and keeps what became of each.

Tasks send their entries one after the other and write every answer, errors included, to a part of
their own; the message by which a task commits names the part and counts its answers. The driver makes
a manifest of the committed parts under a name that nobody else has, so the answers of an attempt that
was lost, or of a task that Spark ran twice, aren't counted. Sending is at least once: a lost attempt's
entries are sent again, so a store has to take the same entry twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from loomgraph.plans import lineage

#: Answers that a task holds before it writes them.
ANSWERS_HELD = 10_000
_SCHEMA = pa.schema([("node_id", pa.string()), ("change", pa.string()), ("message", pa.string()), ("raised", pa.bool_())])
_COLUMNS = "node_id string, change string, message string, raised boolean"


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its part, how many entries it sent, and how many of them raised."""

    part: str
    sent: int
    raised: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, run: str, send: Callable[[str, str, str], str]):
        self.folder, self.run, self.send = folder, run, send

    def write(self, iterator: Iterator[Row]) -> Part:
        system, base = FileSystem.from_uri(self.folder)
        part, sent, raised = f"{uuid.uuid4().hex}.parquet", 0, 0
        with pq.ParquetWriter(f"{base}/{part}", _SCHEMA, filesystem=system) as out:
            held = []
            for row in iterator:
                held.append(self.answer(row))
                sent, raised = sent + 1, raised + held[-1]["raised"]
                if len(held) == ANSWERS_HELD:
                    out.write_batch(pa.RecordBatch.from_pylist(held, _SCHEMA))
                    held = []
            out.write_batch(pa.RecordBatch.from_pylist(held, _SCHEMA))
        return Part(part, sent, raised)

    def answer(self, row: Row) -> dict:
        try:
            message, raised = self.send(row.node_id, row.change, row.detail), False
        except Exception as error:  # noqa: BLE001 - whatever one entry meets, the others go on
            message, raised = f"{type(error).__name__}: {error}", True
        return {"node_id": row.node_id, "change": row.change, "message": message, "raised": raised}

    def commit(self, messages: list[Part | None]) -> None:
        parts = [vars(m) for m in messages if m is not None]
        system, base = FileSystem.from_uri(self.folder)
        with system.open_output_stream(f"{base}/{self.run}.staged") as out:
            out.write(json.dumps(parts).encode())
        system.move(f"{base}/{self.run}.staged", f"{base}/{self.run}.manifest")

    def abort(self, messages: list[Part | None]) -> None:
        """Parts without a manifest are never read."""


def _sink(send: Callable[[str, str, str], str]) -> type[DataSource]:
    class Outcomes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "entry_outcomes"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(self.options["path"], self.options["run"], send)

    return Outcomes


def applied(diffs: DataFrame, send: Callable[[str, str, str], str], folder: str | None = None) -> DataFrame:
    """node_id, change, message, raised: every entry of ``diffs`` (node_id, change, detail) sent, with its answer.

    ``send`` runs in tasks and gives the store's message; what it raises is the message of that entry,
    and the others go on. A null message is an entry without an answer. ``folder`` (a URI that all tasks
    reach) keeps the answers of every call.
    """
    spark, run = diffs.sparkSession, uuid.uuid4().hex
    folder = folder or lineage.fresh(spark, "outcomes")
    folder = folder if ":/" in folder else f"file://{folder}"
    system, base = FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    spark.dataSource.register(_sink(send))
    entries = diffs.select(*[F.col(c).cast("string") for c in ("node_id", "change", "detail")])
    entries.write.format("entry_outcomes").option("run", run).mode("append").save(folder)
    return answers(spark, folder, run)


def committed(folder: str, run: str) -> list[Part]:
    system, base = FileSystem.from_uri(folder)
    with system.open_input_stream(f"{base}/{run}.manifest") as file:
        return [Part(**p) for p in json.loads(file.read())]


def answers(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """The answers of a committed run."""
    parts = [f"{folder}/{p.part}" for p in committed(folder, run) if p.sent]
    return spark.read.schema(_COLUMNS).parquet(*parts) if parts else spark.createDataFrame([], _COLUMNS)
