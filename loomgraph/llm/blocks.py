"""Documents in blocks, and count tables partitioned by hash that blocks are joined to.

A block holds the texts of some documents one after the other. Each block asks for the counts of its
distinct keys over all blocks: its keys are dealt by hash into buckets, one row per block and bucket,
a bucket adds up the counts of equal keys, and the answers are joined to the blocks again. A key that
many documents have is one entry per block, so no bucket grows with a hot key's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bodies, saved, scratch, shuffle_partitions

BLOCK_BYTES = 4 << 20
#: Keys that one bucket holds in a task's memory.
BUCKET_KEYS = 3_000_000
#: More buckets than these are reached in two steps.
ONE_STEP = 4096
#: Partitions of a shuffle by bucket; with more buckets a partition holds several, in order.
PARTITIONS = 50_000
#: Stands for a null doc_id: larger than any other.
NO_ID = np.iinfo(np.int64).max
_REST = np.uint64((1 << 40) - 1)
# Fixed value: an odd multiplier of 64 bits.
_SPREAD = 0x9E3779B97F4A7C15
#: Numbers of a task's blocks lie below the task's own number.
_TASK_SHIFT = 36
_SCHEMA = "block long, size int, body binary, ids binary, ends binary, carried binary"


class Block(NamedTuple):
    number: int
    text: np.ndarray  # uint8, the documents' bytes one after the other
    ids: np.ndarray  # int64, a document's doc_id; NO_ID if null
    ends: np.ndarray  # int64, where each document ends
    carried: list[pa.Array]  # of each carried column
    settled: np.ndarray = np.zeros((2, 0), np.int64)  # first places, and places past the last, that need no more work

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def make_blocks(docs: DataFrame, size: int = BLOCK_BYTES, carry: list[str] | None = None, level: int | None = None) -> DataFrame:
    """The blocks of ``docs``, a table below the shared folder; null texts are empty.

    Columns named in ``carry`` go along as Arrow streams. ``level`` is how hard zstd packs the texts.
    The table is bucketed by block as its tasks write it, a file for each task, so answers are joined to
    it where it lies: only they are shuffled, never the texts. A small table is dealt to all cores before.
    """
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, slices, total, n = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            raw = b"".join(held)
            ends = np.cumsum([len(b) for b in held], dtype=np.int64)
            packed = pa.Codec("zstd", level).compress(raw, asbytes=True)
            row = [n, len(raw), packed, np.array(ids, np.int64).tobytes(), ends.tobytes(), stream(slices)]
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            first, others = 0, batch.select(list(range(2, batch.num_columns)))
            for at, (doc_id, body) in enumerate(zip(batch.column(0).fill_null(NO_ID).to_pylist(), bodies(batch.column(1))), 1):
                held.append(body)
                ids.append(doc_id)
                total += len(body)
                if total >= size:
                    slices.append(others.slice(first, at - first))
                    yield out()
                    held, ids, slices, total, n, first = [], [], [], 0, n + 1, at
            slices.append(others.slice(first))
        if held:
            yield out()

    def stream(slices: list[pa.RecordBatch]) -> bytes:
        if not carry:
            return b""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, slices[0].schema) as writer:
            for part in slices:
                writer.write_batch(part)
        return sink.getvalue().to_pybytes()

    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body, *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)])
    rows = source.mapInArrow(run, _SCHEMA).withColumn("block", _number(shuffle_partitions(docs.sparkSession)))
    return by_block(rows, "blocks")


def _number(buckets: int) -> Column:
    """A number for a task's n-th block (column ``block``) by which all blocks of the task fall into one bucket.

    Each block has numbers of its own to choose from, eight for each bucket; where none of them falls into
    the task's bucket (one block in 3,000), its first one is taken, which costs a file more.
    """
    task, choice = F.spark_partition_id().cast("long"), F.lit(8 * buckets).cast("long")
    first = F.shiftleft(task, _TASK_SHIFT) + F.col("block") * choice
    fitting = F.filter(F.sequence(first, first + choice - 1), lambda n: F.pmod(F.hash(n), F.lit(buckets)) == F.pmod(task, F.lit(buckets)))
    return F.coalesce(F.get(fitting, F.lit(0)), first)


def by_block(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table below the shared folder, bucketed by block; nothing stays in the catalog."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.write.format("parquet").bucketBy(shuffle_partitions(spark), "block").option("path", path).saveAsTable(table)
    # The frame is resolved, buckets included, so the entry can go; the files stay.
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def read_blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Blocks of rows; what is settled is a list of (first, past), as ``joined`` gives it."""
    numbers, sizes = batch.column("block").to_pylist(), batch.column("size").to_pylist()
    settled = lists(batch, "settled") if "settled" in batch.schema.names else repeat([])
    for i, (packed, parts) in enumerate(zip(bodies(batch.column("body")), settled)):
        text = np.frombuffer(pa.decompress(packed, sizes[i], codec="zstd", asbytes=True), np.uint8) if sizes[i] else np.zeros(0, np.uint8)
        ids, ends = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "ends"))
        kept = batch.column("carried")[i].as_py()
        columns = pa.ipc.open_stream(kept).read_all().combine_chunks().columns if kept else []
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        done = [np.stack([unpack(p[c], "<u4") for c in ("first", "past")]).astype(np.int64) for p in parts]
        yield Block(numbers[i], text, ids, ends, columns, np.concatenate([np.zeros((2, 0), np.int64), *done], axis=1))


class Keys(NamedTuple):
    """A block's distinct keys, in order of bucket and rest, and what they were made from."""

    bucket: np.ndarray
    rest: np.ndarray
    counts: np.ndarray
    place: np.ndarray  # of each given key among the distinct ones


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of whole keys: they cut the range of the high 32 bits, so both have one order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def distinct_keys(keys: np.ndarray, buckets: int, whole: bool = False) -> Keys:
    """``whole``: rest is the whole key, so different keys stay apart; else bucket and 40 bits, which only propose."""
    if whole:
        found, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return Keys(bucket_of(found, buckets), found, counts, place)
    # The bucket comes from the high bits, the rest are 40 bits that are kept whole.
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint64)
    found, place, counts = np.unique(bucket << np.uint64(40) | keys & _REST, return_inverse=True, return_counts=True)
    return Keys((found >> np.uint64(40)).astype(np.int64), found & _REST, counts, place)


def mixed(number: int) -> int:
    """32 bits that depend on all of a block's number."""
    return number * _SPREAD % (1 << 64) >> 32


def buckets_for(blocks: DataFrame, keys_per_byte: float) -> int:
    total = blocks.agg(F.sum("size")).first()[0] or 0
    return max(shuffle_partitions(blocks.sparkSession), int(total * keys_per_byte / BUCKET_KEYS) + 1)


def pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(raw, kind)


def pack_sorted(values: np.ndarray, width: int = 5) -> bytes:
    """Ascending numbers as steps, byte by byte: high bytes of steps are alike."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return pack(np.ascontiguousarray(steps.T).ravel())


def unpack_sorted(data: bytes, width: int = 5) -> np.ndarray:
    planes = unpack(data, "u1").reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"))


def _rows(bucket: np.ndarray, block: int, rests: np.ndarray, counts: np.ndarray, width: int) -> pa.RecordBatch:
    """One row per bucket of ascending keys."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    columns = [
        pa.array(bucket[cuts[:-1]].astype(np.int32)),
        pa.array(np.full(len(parts), block)),
        pa.array([pack_sorted(rests[a:b], width) for a, b in parts], pa.binary()),
        pa.array([pack(counts[a:b]) for a, b in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _ASKED_NAMES)


_ASKED = "bucket int, block long, rests binary, counts binary"
_ASKED_NAMES = ["bucket", "block", "rests", "counts"]
_Held = list[tuple[int, bytes, bytes]]  # block, rests, counts


def _per_bucket(asked: DataFrame, buckets: int, merge: Callable[[int, _Held], pa.RecordBatch], schema: str) -> DataFrame:
    """``merge`` of all rows of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            values = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies(batch.column(2)), bodies(batch.column(3)))
            for bucket, block, rests, counts in values:
                if bucket != now and held:
                    yield merge(now, held)
                    held = []
                now = bucket
                held.append((block, rests, counts))
        if held:
            yield merge(now, held)

    if buckets <= PARTITIONS:
        dealt = asked.repartitionById(buckets, "bucket")
    else:
        place = F.floor(F.col("bucket").cast("long") * PARTITIONS / buckets).cast("int")
        dealt = asked.repartitionById(PARTITIONS, place).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, schema)


def _answers(asked: DataFrame, buckets: int, width: int, kind: str) -> DataFrame:
    """For each row of ``asked`` the counts of its keys over all rows of its bucket."""

    def totals(bucket: int, held: _Held) -> pa.RecordBatch:
        keys = [unpack_sorted(r, width) for _, r, _ in held]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c, kind) for _, _, c in held])
        total = np.bincount(place, counts).astype("<u8")[place]
        ends = np.cumsum([len(k) for k in keys])
        parts = [pack(x) for x in np.split(total, ends[:-1])]
        columns = [pa.array([b for b, _, _ in held], pa.int64()), pa.array(np.full(len(held), bucket, np.int32)), pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "totals"])

    return _per_bucket(asked, buckets, totals, "block long, bucket int, totals binary")


def counted(blocks: DataFrame, keys_of: Callable[[Block], np.ndarray], buckets: int, whole: bool = False, keep: bool = False) -> DataFrame:
    """``blocks`` with ``totals``: (bucket, packed counts over all blocks) of its distinct keys.

    ``keys_of`` gives a block's keys (64 bits, repeats included). ``totals_of`` reads the answers.
    ``whole`` is that of ``distinct_keys``. ``keep`` writes the answers, for results read more than once.
    """
    hold = (lambda answers: saved(answers, "answers")) if keep else (lambda answers: answers)
    if buckets > ONE_STEP:
        return joined(blocks, hold(_answers_in_two_steps(blocks, keys_of, buckets, whole)), "totals")
    width = 8 if whole else 5

    def asks(block: Block) -> pa.RecordBatch:
        own = distinct_keys(keys_of(block), buckets, whole)
        return _rows(own.bucket, block.number, own.rest, own.counts.astype("<u4"), width)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(asks, read_blocks(batch))

    return joined(blocks, hold(_answers(blocks.mapInArrow(ask, _ASKED), buckets, width, "<u4")), "totals")


_UNIT = "block long, keys binary, counts binary, blocks binary, sizes binary, places binary"


def _answers_in_two_steps(blocks: DataFrame, keys_of: Callable[[Block], np.ndarray], buckets: int, whole: bool) -> DataFrame:
    """Counts of the blocks' keys by range of buckets, through units of a range and a group of blocks."""
    ranges = math.isqrt(buckets - 1) + 1
    groups = -(-buckets // ranges)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in read_blocks(batch):
                own = distinct_keys(keys_of(block), buckets, whole)
                keys = own.rest if whole else own.bucket.astype(np.uint64) << np.uint64(40) | own.rest
                group = mixed(block.number) % groups
                yield _rows(own.bucket * ranges // buckets * groups + group, block.number, keys, own.counts.astype("<u4"), 8)

    def unit(number: int, held: _Held) -> pa.RecordBatch:
        keys = [unpack_sorted(r, 8) for _, r, _ in held]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unpack(c, "<u4") for _, _, c in held])).astype("<u8")
        members, sizes = np.array([b for b, _, _ in held], "<i8"), np.array([len(k) for k in keys], "<u4")
        values = [pack_sorted(found, 8), *map(pack, (counts, members, sizes, place.astype("<u4")))]
        columns = [pa.array([number], pa.int64()), *[pa.array([v], pa.binary()) for v in values]]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _UNIT.split(", ")])

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed, counts in zip(batch.column("block").to_pylist(), bodies(batch.column("keys")), bodies(batch.column("counts"))):
                keys = unpack_sorted(packed, 8)
                bucket = bucket_of(keys, buckets) if whole else (keys >> np.uint64(40)).astype(np.int64)
                yield _rows(bucket, number, keys, unpack(counts, "<u8"), 8)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("block").to_pylist()
            packed = zip(*[bodies(batch.column(c)) for c in ("blocks", "sizes", "places")])
            for number, values, parts in zip(numbers, packed, lists(batch, "totals")):
                members, sizes, place = (unpack(v, kind) for v, kind in zip(values, ("<i8", "<u4", "<u4")))
                total = np.split(totals_of(parts)[place], np.cumsum(sizes)[:-1])
                columns = [pa.array(members), pa.array(np.full(len(members), number // groups, np.int32)), pa.array([pack(t) for t in total], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "totals"])

    units = by_block(_per_bucket(blocks.mapInArrow(ask, _ASKED), ranges * groups, unit, _UNIT), "units")
    answers = _answers(units.mapInArrow(ask_again, _ASKED), buckets, 8, "<u8")
    return joined(units, answers, "totals").mapInArrow(back, "block long, bucket int, totals binary")


def joined(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``blocks`` with what ``answers`` (block, and columns that become ``name``, a list) has for them, else null."""
    return blocks.join(gathered(answers, name), "block", "left")


def gathered(answers: DataFrame, name: str) -> DataFrame:
    """A row for each block that ``answers`` has: block, and the list of its other columns as ``name``."""
    dealt = answers.repartition(shuffle_partitions(answers.sparkSession), "block")
    return dealt.groupBy("block").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "block"])).alias(name))


def lists(batch: pa.RecordBatch, column: str) -> Iterator[list[dict]]:
    """The list of structs of each row; a null is an empty list."""
    for value in batch.column(column):
        yield value.as_py() or []


def totals_of(parts: list[dict]) -> np.ndarray:
    """The counts for ``Keys`` of the block, in their order."""
    ordered = sorted(parts, key=lambda p: p["bucket"])
    return np.concatenate([unpack(p["totals"], "<u8") for p in ordered]) if ordered else np.zeros(0, "<u8")
