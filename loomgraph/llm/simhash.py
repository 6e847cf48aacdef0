"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A fingerprint of 64 bits becomes a vector of 32 bit counts, one for each pair of bits. The
Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints.
The 32 coordinates are dealt into ``g`` groups. Vectors at Manhattan distance ``d`` or less differ
in at most ``d`` groups, hence agree on ``g - d`` of them: projected on each choice of ``g - d``
groups, every linked pair falls into one cell of the grid at least. Only rows of one cell are
compared, first by Manhattan, then by Hamming distance.

A cell gives a spanning forest of its links, never all pairs; a cell of more than ``CELL`` members
is cut into blocks, and pairs of blocks are compared in separate tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bodies, join_counted, saved, tie, with_bytes
from loomgraph.llm.components import connected_components, forest

#: Cells above this many fingerprints are compared block by block.
CELL = 4096
_PAIRS = 0x5555555555555555


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (64 bits as a long).

    Words are runs of bytes other than 20 and 09-0D (hex) after A-Z are lower-cased. Fewer words
    than ``shingle`` make one shingle; no words, or a null text, give 0. Repeats count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, hashes, counts = batch.column(0), [], [], []
            pending = 0
            for body in bodies(batch.column(1)):
                words = body.lower().split()
                if len(words) > shingle:
                    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
                    n = len(words) - shingle + 1
                else:
                    parts, n = ([b" ".join(words)], 1) if words else ((), 0)
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, n))
                counts.append(n)
                pending += n
                if pending > 200_000:
                    fps.append(_majority(hashes, counts))
                    hashes, counts, pending = [], [], 0
            fps.append(_majority(hashes, counts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "fp"])

    return with_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, fp long")


def _majority(hashes: list[np.ndarray], counts: list[int]) -> np.ndarray:
    """A fingerprint for each document: bits set in over half of its hashes."""
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    raw = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    starts = np.concatenate([[0], np.cumsum(n[has])[:-1]])
    packed = np.empty((len(has), 8), np.uint8)
    for byte in range(8):
        bits = np.unpackbits(raw[:, byte, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        packed[:, byte] = np.packbits(2 * ones > n[has, None], axis=1, bitorder="little")[:, 0]
    out[has] = packed.reshape(-1).view("<u8")
    return out


def groups_for(n: int, distance: int) -> int:
    """The number of groups that costs least for ``n`` fingerprints: keys made plus pairs met."""

    def cost(g: int) -> float:
        return math.comb(g, distance) * (1 + n / 2 ** (48 * (g - distance) / g))

    return min(range(distance + 1, 13), key=cost)


def cell_masks(groups: int, distance: int) -> list[int]:
    """The bits of the embedding that each choice of ``groups - distance`` groups keeps (signed)."""
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    group = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(group, groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 3, cell: int = CELL) -> DataFrame:
    """Forest of links between distinct fingerprints ``fp``: columns ``a``, ``b``.

    Two fingerprints are connected by these rows exactly if a chain of steps of at most
    ``distance`` bits connects them.
    """
    masks = cell_masks(groups_for(fps.count(), distance), distance)
    half, odd = F.shiftrightunsigned("fp", 1), F.lit(_PAIRS)
    both = F.col("fp").bitwiseAND(half).bitwiseAND(odd)
    embedding = F.col("fp").bitwiseXOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(both, 1))
    cells = fps.select("fp", embedding.alias("e")).select(
        "fp",
        F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "key"),
    )
    near = lambda fp, group: _close_pairs(fp[:, 0], group, distance)
    return cell_links(cells, fps, "fp", ["fp"], near, cell)


Near = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def cell_links(cells: DataFrame, fps: DataFrame, key: str, words: list[str], near: Near, cell: int) -> DataFrame:
    """Forest of links (a, b) between members of one cell.

    ``cells`` has grid, key, and the columns of ``fps``: an identifier and the words of a fingerprint.
    ``near`` gets fingerprints (one a row) and their ascending groups, and gives places of a spanning
    forest of the links within groups.
    """
    found = saved(_in_cells(cells, ["grid", "key"], key, words, near, cell), "simhash-cells")
    small = found.filter(~F.col("big")).select("a", "b")
    large = found.filter("big").select(F.col("a").alias(key), "grid", "key")
    if large.isEmpty():
        return small
    sizes = large.groupBy("grid", "key").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    dealt = (
        large.join(sizes, ["grid", "key"])
        .select(key, "grid", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(key, "grid", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        .join(fps, key)
    )
    return small.union(_in_cells(dealt, ["grid", "key", "lo", "hi"], key, words, near, None).select("a", "b"))


def _in_cells(rows: DataFrame, keys: list[str], own: str, words: list[str], near: Near, cell: int | None) -> DataFrame:
    """Links within each group of equal ``keys``; members of groups above ``cell`` come back as big rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_ids, held = np.zeros((0, len(keys)), np.int64), np.zeros(0, np.int64), np.zeros((0, len(words)), np.uint64)
        big_key = None
        for batch in batches:
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
            fp = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
            now, fp = np.concatenate([held_keys, now]), np.concatenate([held, fp])
            ids = np.concatenate([held_ids, batch.column(own).to_numpy()])
            starts = np.flatnonzero(np.r_[True, (now[1:] != now[:-1]).any(axis=1)])
            last = starts[-1]
            if cell and len(fp) - last > cell:
                big_key = tuple(now[last])
                last = len(fp)
            yield from finish(now[:last], ids[:last], fp[:last], big_key)
            held_keys, held_ids, held = now[last:], ids[last:], fp[last:]
        if len(held):
            yield from finish(held_keys, held_ids, held, big_key)

    def finish(now: np.ndarray, ids: np.ndarray, fp: np.ndarray, big_key: tuple | None) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        change = np.r_[True, (now[1:] != now[:-1]).any(axis=1)]
        group = np.cumsum(change) - 1
        size = np.bincount(group)
        big = size > cell if cell else np.zeros(len(size), bool)
        if big_key is not None:
            big |= (now[change] == np.array(big_key)).all(axis=1)
        out = big[group]
        if out.any():
            yield batch_of(ids[out], ids[out], now[out][:, :2], True)
        several = ~out & (size > 1)[group]
        ids, fp, group = ids[several], fp[several], group[several]
        a, b = near(fp, group)
        if len(a):
            yield batch_of(ids[a], ids[b], np.zeros((len(a), 2), np.int64), False)

    def batch_of(a: np.ndarray, b: np.ndarray, key: np.ndarray, big: bool) -> pa.RecordBatch:
        columns = [a, b, key[:, 0].astype(np.int32), key[:, 1], np.full(len(a), big)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "grid", "key", "big"])

    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(run, "a long, b long, grid int, key long, big boolean")


def _close_pairs(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the pairs within ``distance`` bits, within each group."""
    e = fp - ((fp >> np.uint64(1)) & np.uint64(_PAIRS))
    low, high = e & np.uint64(0x3333333333333333), (e >> np.uint64(2)) & np.uint64(0x3333333333333333)
    at = np.arange(len(fp))
    found_a, found_b, held, k = [], [], 0, 0
    while len(at):
        k += 1
        at = at[at + k < len(fp)]
        at = at[group[at] == group[at + k]]
        if not len(at):
            break
        near = at[_manhattan_at_most(low, high, at, at + k, distance)]
        near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= distance]
        found_a.append(near)
        found_b.append(near + k)
        held += len(near)
        if held > 1_000_000:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b), len(fp))
            found_a, found_b, held = [a], [b], len(a)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found_a), np.concatenate(found_b), len(fp))


def _manhattan_at_most(low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Whether the vectors of counts lie within ``distance``: 16 + 16 counts in fields of 4 bits."""
    total = np.zeros(len(i), np.int64)
    guard, unit = np.uint64(0x4444444444444444), np.uint64(0x7777777777777777)
    for part in (low, high):
        diff = (part[i] | guard) - part[j]  # each field: 4 + difference, 2 to 6
        # |d| by field: 4 + d has the values 2, 3, 4, 5, 6 for |d| = 2, 1, 0, 1, 2
        diff &= unit
        one = diff & np.uint64(0x1111111111111111)
        two = (diff >> np.uint64(1)) & np.uint64(0x1111111111111111) & ~one
        total += np.bitwise_count(one).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)
    return total <= distance


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest doc_id reachable.

    Null texts count as empty; they share fingerprint zero, which links like any other. Rows with a
    null doc_id are kept and never name a component, unless all of its ids are null. Repeated rows
    stay repeated. Other columns of ``docs`` are not read.
    """
    marks = saved(fingerprints(docs, shingle), "simhash-fp")
    distinct = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    classes = components(distinct, "fp", links(distinct.select("fp"), distance))
    return join_counted(marks, classes, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def components(distinct: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``distinct`` with component_id: the least first_id of all that links reach from its ``key``."""
    roots = connected_components(saved(found, "simhash-links"))
    rooted = distinct.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return saved(rooted.join(smallest, "root").drop("root"), "simhash-classes")


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each group of rows of ``docs`` the one with the smallest doc_id (a null is the last choice).

    ``grouped`` gets (doc_id, text), doc_id being a number of the row, and gives doc_id, component_id.
    Of rows equal in doc_id the least hash of all columns decides. Columns of any name stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row_id"), row), "near-rows")
    found = grouped(rows.select(F.col("row_id").alias("doc_id"), F.col("row.text").alias("text")))
    own = rows.select("row_id", F.col("row.doc_id").cast("long").alias("doc_id"), tie("row", docs.columns).alias("tie"))
    keyed = own.join(found.select(F.col("doc_id").alias("row_id"), "component_id"), "row_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row_id")).alias("first")
    keyed = saved(keyed, "near-groups")
    several = keyed.groupBy("component_id").agg(first, F.count("*").alias("n")).filter("n > 1")
    gone = join_counted(keyed, saved(several, "near-first"), ["component_id"]).filter("row_id <> first.row_id").select("row_id")
    # What goes is the smaller side, whatever the join.
    return rows.join(saved(gone, "near-gone"), "row_id", "left_anti").select("row.*")


def representatives(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of ``near_duplicates``."""
    return one_of_each(docs, lambda rows: near_duplicates(rows, shingle, distance))
