"""Exact deduplication by a stateful stream.

Arrivals are appended to a store below the shared folder, and a stream reads them: digest, identifier
and place of the content (``run``, ``row_id``). Its state is keyed by digest, kept in RocksDB on disk,
never expires, and holds the least identifier, where its content lies, and how many rows came. A later
run with the same store goes on from that state. Then the full bytes of the rows whose digest was hit
are compared; rows of one digest and different bytes are grouped by their bytes.

A bitmap of hit digests, of fixed size, is broadcast to the tasks that read texts, so texts whose digest
came once stay where they are. Bytes are compared by partial minima and maxima in those tasks, so a
digest of very many rows is one row per task after it. Results are joined to the rows of hot digests by
a bounded broadcast.

A run is staged and then renamed into the arrivals, so it is there as a whole or not at all. One that
has a name can be repeated after any failure: rows that arrived aren't written again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import exists, join_counted, move, saved, scratch, tie

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Staged files that one micro-batch takes.
FILES_PER_BATCH = 1000
#: Parts of the bitmap of hit digests, of 4 KB each: what is broadcast never passes 16 MB.
BITMAP_PARTS = 4096
_PART_BITS = 32768  # fixed value: bits of a part, of the bitmap functions
_FIRST = "struct<none:boolean,doc_id:bigint,tie:bigint,run:string,row_id:bigint>"


def normalised(text: Column) -> Column:
    """Each run of bytes 20 and 09-0D (hex) as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def body() -> Column:
    return normalised(F.col("row.text")).cast("binary")


def least() -> Column:
    """The row that stays: the least doc_id (nulls last), of equal ones the least hash of all it holds."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "run", "row_id")).alias("first")


# ---- the store


def add(docs: DataFrame, store: str, digest: Callable[[Column], Column] = sha256, run: str | None = None) -> None:
    """Append the rows of ``docs`` to ``store`` and run its stream to its end.

    Arrivals: run (a name), row_id, doc_id, digest, text_sha256, tie (a hash of the whole row, which
    doesn't depend on how rows are dealt) and the row itself. Every addition to a store has the same
    columns. A ``run`` that arrived before adds nothing, whatever ``docs`` holds; only the stream goes
    on, so a failed addition is repeated under its name. Without a name every call adds its rows.
    """
    spark, run = docs.sparkSession, run or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", run):
        raise ValueError(f"A run's name is made of letters, digits and hyphens: {run!r}")
    if not exists(spark, f"{store}/arrivals/{run}"):
        _arrive(docs, store, digest, run)
    _stream(spark, store)


def _arrive(docs: DataFrame, store: str, digest: Callable[[Column], Column], run: str) -> None:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("row"))
    rows = rows.withColumn("body", body()).select(
        F.lit(run).alias("run"), "row_id", F.col("row.doc_id").cast("long").alias("doc_id"), digest(F.col("body")).cast("string").alias("digest"),
        sha256(F.col("body")).alias("text_sha256"), tie("row", docs.columns).alias("tie"), "row",
    )
    staged = f"{store}/staged/{run}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(staged)
    move(docs.sparkSession, staged, f"{store}/arrivals/{run}")


def arrivals_of(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/arrivals/*")


def _stream(spark: SparkSession, store: str) -> None:
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "300")
    # A store that no task works on is closed: its state lies in the checkpoint, not on a local disk.
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "doc_id long, tie long, run string, row_id long, digest string"
    # A run may wait for its repetition while later ones pass it: its files never grow too old.
    source = own.readStream.schema(columns).option("maxFilesPerTrigger", FILES_PER_BATCH).option("maxFileAge", "36500d")
    arriving = source.parquet(f"{store}/arrivals/*")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/groups/batch={number}")

    query = (
        arriving.groupBy("digest").agg(least(), F.count("*").alias("n"))
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{store}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()


def groups(spark: SparkSession, store: str) -> DataFrame:
    """digest, first, n of everything that came: of a digest's rows by batch the last is the whole."""
    folder = f"{store}/groups"
    if not exists(spark, folder):
        return spark.createDataFrame([], f"digest string, first {_FIRST}, n long")
    rows = spark.read.schema(f"digest string, first {_FIRST}, n long, batch long").parquet(folder)
    return rows.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("last")).select("digest", "last.first", "last.n")


def hits(arrivals: DataFrame, found: DataFrame) -> DataFrame:
    """digest, text of the arrivals whose digest came more than once, and few others.

    Digests of one row pass only where their bit is another's. The bitmap has a fixed size, so with very
    many hits more texts pass; none that was hit is left out.
    """
    place = F.pmod(F.xxhash64("digest"), F.lit(BITMAP_PARTS * _PART_BITS)) + 1
    part, bit = F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")
    bitmap = found.filter("n > 1").select(part, bit).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    rows = arrivals.select("digest", F.col("row.text").alias("text"), part, bit).join(F.broadcast(bitmap), "part")
    octet = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.filter(F.getbit(octet, (F.col("bit") % 8).cast("int")) == 1).select("digest", "text")


def decided(spark: SparkSession, store: str) -> DataFrame:
    """run, row_id, doc_id, text_sha256, first, n for every row of the store, by full bytes."""
    arrivals = arrivals_of(spark, store)
    found = saved(groups(spark, store), "dedup-groups")
    bodies = hits(arrivals, found).select("digest", normalised(F.col("text")).cast("binary").alias("body"))
    sizes = bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    collided = saved(sizes.filter("low <> high").select("digest"), "dedup-collided")
    rows = arrivals.select("run", "row_id", "doc_id", "tie", "digest", "text_sha256")
    out = ("run", "row_id", "doc_id", "text_sha256", "first", "n")
    if collided.isEmpty():
        return join_counted(rows, found, ["digest"]).select(*out)
    plain = join_counted(rows.join(collided, "digest", "left_anti"), found, ["digest"]).select(*out)
    mixed = arrivals.join(collided, "digest", "left_semi").withColumn("body", body())
    by_bytes = mixed.groupBy("digest", "body").agg(least(), F.count("*").alias("n"))
    return plain.unionByName(mixed.join(by_bytes, ["digest", "body"]).select(*out))


# ---- results


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, store: str | None = None, run: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. Of rows with equal text and equal (or null) doc_id
    one is kept, the same one however rows are dealt. Other columns are not read. ``digest`` of
    different bytes may be equal: full bytes decide. With a ``store`` of earlier runs its rows count,
    and come back, too; ``run`` is that of ``add``.
    """
    spark, store = docs.sparkSession, store or scratch(docs.sparkSession, "dedup")
    add(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), store, digest, run)
    return decided(spark, store).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"), "text_sha256"
    )


def first_copies(docs: DataFrame, store: str | None = None, run: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, the one with the least doc_id.

    Null and empty texts are equal to each other, so one of them all stays; a null doc_id is the last
    choice. Of rows equal in doc_id and text one stays, chosen by a hash of all its columns; columns of
    any name stay as they are. With a ``store`` of earlier runs its rows count, and come back, too;
    ``run`` is that of ``add``.
    """
    spark, store = docs.sparkSession, store or scratch(docs.sparkSession, "dedup")
    add(docs, store, run=run)
    gone = saved(decided(spark, store).filter(~_stays()).select("run", "row_id"), "dedup-gone")
    # What goes is the smaller side, whatever the join.
    return arrivals_of(spark, store).join(gone, ["run", "row_id"], "left_anti").select("row.*")


def _stays() -> Column:
    return (F.col("run") == F.col("first.run")) & (F.col("row_id") == F.col("first.row_id"))
