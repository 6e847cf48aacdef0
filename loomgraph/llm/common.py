"""What the operators of this subpackage share: the shared folder, written tables, byte views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _paths.get()) is not None:
        paths.append(path)
    return path


#: Paths given out since the step began that is running, if there is one.
_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """What is written to paths of ``scratch`` within goes at the end, so by then nothing may need it."""
    token = _paths.set([])
    try:
        yield
        for path in _paths.get():
            discard(spark, path)
    finally:
        _paths.reset(token)


def discard(spark: SparkSession, path: str) -> None:
    """A folder of our own below the shared one goes; nothing may read it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder (to ``path``, one of ``scratch``, if given) and go on from the files.

    This cuts the lineage in a way that a lost executor can't undo.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to ``target``, which isn't there yet; its parent is made."""
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    system = paths[1].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(paths[1].getParent())
    if not system.rename(*paths):
        raise OSError(f"{source} was not moved to {target}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt to all cores if it has fewer partitions: one row group is one task else."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def with_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the text's UTF-8 bytes as ``body``; a null text is empty."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    return docs.select(*keep, body)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer if ``columns`` has it already (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_place(df: DataFrame) -> StructType:
    """The schema of ``df`` with names that any place in a plan takes."""
    return StructType([StructField(f"column_{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema)])


def tie(row: str, columns: list[str]) -> Column:
    """A hash of all columns of the struct ``row``, which doesn't depend on how rows are dealt."""
    others = F.struct(*[F.col(f"{row}.`{c}`") for c in columns if c != "text"])
    return F.xxhash64(f"{row}.text", F.to_json(others))


#: A key is hot above so many rows; no more keys than this many ever count as hot.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def join_counted(rows: DataFrame, groups: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with what ``groups`` (unique on ``key``, with the number ``n`` of rows) says of them.

    Hot keys are joined where their rows lie: fewer than total / bound keys have more than bound rows,
    so what is broadcast is bounded. All others are shuffled. ``groups`` should be a written table.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = groups.filter(F.col("n") > bound)
    if hot.isEmpty():
        return rows.join(groups, key, how)
    hot = F.broadcast(hot)
    cold = rows.join(hot, key, "left_anti").join(groups.filter(F.col("n") <= bound), key, how)
    return cold.unionByName(rows.join(hot, key))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a binary column as uint8 and its n + 1 offsets, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, ends.astype(np.int64)


def bodies(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column, one at a time."""
    values, ends = byte_arrays(column)
    view = memoryview(values)
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield bytes(view[start:end])
