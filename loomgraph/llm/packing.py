"""Packing token sequences by non-negative least squares over a histogram of lengths.

Every document is cut into full windows and a remainder. Combinations of up to three remainder
lengths that fill a window exactly are the columns of a least-squares problem against the histogram
of remainders; its rounded solution says how often each combination is used. What is left is laid
end to end and cut at the windows' ends.

The driver sees the histogram only (at most a count for each length below the window). A remainder's
place follows from its rank among remainders of its length: its rank within the task that encoded
it, plus those of the tasks before.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations_with_replacement, compress, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from loomgraph.llm import bpe
from loomgraph.llm.bpe import CACHE_WORDS
from loomgraph.llm.common import bodies, saved, with_bytes

WINDOW, END_ID = 1024, 0
#: Lengths, most frequent first, of which two may stand in a combination of three.
TRIPLE_LENGTHS = 64
ROUNDS = 400
#: Characters of distinct stretches kept with their ids before the table starts anew, as with ``CACHE_WORDS`` stretches.
CACHE_CHARACTERS = 32_000_000
#: New stretches are encoded in texts of about so many bytes; the library takes longer for a byte of longer ones.
JOINED_BYTES = 1000


class Numbers(dict):
    """Numbers from 0, given to keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def appended(array: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from place ``used`` on; a new one, twice as long, if they don't fit."""
    if used + len(values) > len(array):
        array = np.concatenate([array[:used], np.empty(used + 2 * len(values), array.dtype)])
    array[used : used + len(values)] = values
    return array


class LibraryEncoder:
    """Ids of whole texts, where the tokenizers library encodes each distinct stretch of text once.

    A stretch is white space and what follows, up to the next white space. Words never go on across
    the place before white space, nor does what follows there change the words before it, so stretches
    are encoded apart from each other. For the same reason many new ones are encoded as one text: the
    library's cost for a text of its own is higher than that of a word. Which ids are a stretch's
    follows from their bytes, as byte-level tokens keep every byte.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        vocabulary = self.library.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a character stands for a byte
        byte_level = self.library.normalizer is None and isinstance(self.library.pre_tokenizer, ByteLevel)
        self.joins = byte_level and not any(re.search(r"\s", t) for t in self.special)
        self.clear()

    def clear(self) -> None:
        """Forget all stretches. ``ids`` holds those of number n from ``ends[n]`` to ``ends[n + 1]``."""
        self.numbers, self.characters = Numbers(), 0
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Take in the ids of the stretches whose numbers follow those taken in so far."""
        within = np.array([self.joins and w[0] in " \n" and not w[-1].isspace() for w in new], bool)
        order = np.concatenate([np.flatnonzero(within), np.flatnonzero(~within)])
        together, n_together = self._joined(list(compress(new, within)))
        alone, n_alone = self._single(list(compress(new, ~within)))
        counts, starts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        counts[order] = np.concatenate([n_together, n_alone])
        starts[order] = np.cumsum(counts[order]) - counts[order]
        known = len(self.numbers) - len(new)
        used = int(self.ends[known])
        self.ids = appended(self.ids, used, gathered(np.concatenate([together, alone]), starts, counts))
        self.ends = appended(self.ends, known + 1, used + np.cumsum(counts))
        self.characters += sum(map(len, new))

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are encoded one by one, end to end, and how many each has."""
        found = []
        for at in range(0, len(words), 10_000):
            found += [x.ids for x in self.library.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", counts.sum()), counts

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of stretches that begin with white space and don't end with it, by fewer and longer texts."""
        size = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words))
        ends = np.cumsum(size)
        cuts = np.searchsorted(ends, np.arange(0, size.sum(), JOINED_BYTES)).tolist() + [len(words)]
        ids, _ = self._single(["".join(words[low:high]) for low, high in zip(cuts, cuts[1:]) if low < high])
        covered = np.cumsum(self.token_bytes[ids])
        if covered[-1:].tolist() != ends[-1:].tolist():  # a vocabulary without a symbol for each byte drops some
            return self._single(words)
        return ids, np.diff(np.searchsorted(covered, ends) + 1, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > CACHE_WORDS or self.characters > CACHE_CHARACTERS:
            self.clear()
        units, lasts, known = [], [0], len(self.numbers)
        for text in texts:
            for i, part in enumerate(bpe.around_special(text, self.special)):
                units += [part] if i % 2 else bpe.stretches(part)
            lasts.append(len(units))
        numbers = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        self.learn(list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1])
        starts = self.ends[numbers]
        counts = self.ends[numbers + 1] - starts
        places = (4 * np.concatenate([[0], np.cumsum(counts)])[lasts]).tolist()
        steps = [slice(at, at + 500_000) for at in range(0, len(units), 500_000)]
        data = b"".join([gathered(self.ids, starts[x], counts[x]).tobytes() for x in steps])
        return [data[low:high] for low, high in zip(places, places[1:])]


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ``counts[i]`` values from ``starts[i]`` on, for each i, end to end."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(counts.sum())]


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


class Plan(NamedTuple):
    """Places for ranks 0, 1, ... of each length: arrays sorted by (length, first rank)."""

    length: np.ndarray
    first: np.ndarray  # rank that a run of places begins with
    sequence: np.ndarray  # sequence of that rank; the next rank has the next sequence
    offset: np.ndarray
    used: np.ndarray  # by length: ranks that have such a place
    rest: np.ndarray  # by length: position, in the line of leftovers, of the first rank beyond
    sequences: int  # leftovers begin with this sequence


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations of one to three present lengths that fill a window exactly."""
    window = len(histogram)
    present = np.flatnonzero(histogram)
    has = histogram > 0
    pairs = [(int(a), int(window - a)) for a in present if 2 * a <= window and has[window - a]]
    common = sorted(present[np.argsort(-histogram[present], kind="stable")][:TRIPLE_LENGTHS].tolist())
    triples = {
        tuple(sorted((a, b, window - a - b)))
        for a, b in combinations_with_replacement(common, 2)
        if 0 < window - a - b and has[window - a - b]
    }
    return pairs + sorted(triples)


def solve(matrix: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |matrix x - counts|, by projected gradients with momentum."""
    x = momentum = np.zeros(matrix.shape[1])
    step, t = 1 / max(np.linalg.norm(matrix, 2) ** 2, 1e-12), 1.0
    for _ in range(ROUNDS):
        new = np.maximum(momentum - step * (matrix.T @ (matrix @ momentum - counts)), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        momentum = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray) -> Plan:
    """Places for ``histogram[n]`` remainders of each length n below the window, ``len(histogram)``."""
    chosen = combinations(histogram)
    left, used = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    rows, sequence = [], 0
    if chosen:
        matrix = np.zeros((len(histogram), len(chosen)))
        for j, lengths in enumerate(chosen):
            for n in lengths:
                matrix[n, j] += 1
        scale = histogram.max()
        times = np.floor(solve(matrix, histogram / scale) * scale + 1e-6).astype(np.int64)
        order = np.argsort(-times, kind="stable")
        for rounded in (True, False):  # the solution first, then whatever still fits
            for j in order.tolist():
                need = {n: chosen[j].count(n) for n in chosen[j]}
                k = min(left[n] // m for n, m in need.items())
                k = int(min(k, times[j])) if rounded else int(k)
                if k <= 0:
                    continue
                offset = 0
                for n in chosen[j]:
                    rows.append((n, int(used[n]), sequence, offset))
                    used[n] += k
                    left[n] -= k
                    offset += n
                sequence += k
    lengths = np.arange(len(histogram))
    rest = np.concatenate([[0], np.cumsum(left * lengths)[:-1]])
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*table.T, used, rest, sequence)


def encoded(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Per document: doc_tokens, checksums of its full windows, and its remainder with a rank in its task."""
    schema = "doc_id long, task int, doc_tokens long, full_first long, full_crc array<long>, length int, rank long, rest binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = encoder(path), np.array(END_ID, "<u4").tobytes()
        task, step = TaskContext.get().partitionId(), 4 * window
        ranks, full = np.zeros(window, np.int64), 0

        def row(ids: bytes) -> tuple:
            nonlocal full
            cut = len(ids) // step * step
            crc = [zlib.crc32(ids[i : i + step]) for i in range(0, cut, step)]
            n = (len(ids) - cut) // 4
            out = (task, len(ids) // 4, full, crc, n, int(ranks[n]), ids[cut:])
            full += len(crc)
            ranks[n] += 1
            return out

        for batch in batches:
            at, first, size, texts = 0, 0, 0, []
            for body in bodies(batch.column(1)):
                texts.append(body.decode())
                size += len(body)
                at += 1
                if size > 2_000_000 or at == batch.num_rows:
                    columns = list(zip(*(row(ids + end) for ids in table.encode(texts))))
                    arrays = [batch.column(0).slice(first, at - first), *(pa.array(c, t) for c, t in zip(columns, types))]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    first, size, texts = at, 0, []

    source = with_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document is its ids and then id 0; a null or empty text is that id alone. Every row of
    ``docs`` is packed, repeated rows and null doc_ids too; other columns are not read. All
    sequences are full but the last one of the leftovers.
    """
    rows = saved(encoded(docs, path, window), "packing-ids")
    histogram = np.zeros(window, np.int64)
    for r in rows.filter("length > 0").groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    places = plan(histogram)
    per_task = rows.filter("length > 0").groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(before, ["length", "task"], "left").select(
        "doc_id", "task", "doc_tokens", "full_first", "full_crc", "length", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "rest"
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield place(batch.slice(at, 2000))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        task, tokens, full_first, length, rank = (batch.column(c).to_numpy() for c in ("task", "doc_tokens", "full_first", "length", "rank"))
        crc = batch.column("full_crc")
        full = np.diff(crc.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), full)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        whole = np.stack([k * window, np.full(len(k), window), crc.flatten().to_numpy(), tokens[owner], ((task[owner].astype(np.int64) + 1) << 40) + full_first[owner] + k, np.zeros(len(k), np.int64)])
        mine = np.flatnonzero(length > 0)
        rest, start = list(bodies(batch.column("rest"))), full * window
        at = _search(places, length[mine], rank[mine])
        fits = at >= 0
        a, run_at = mine[fits], at[fits]
        checks = np.array([zlib.crc32(rest[i]) for i in a.tolist()], np.int64)
        fitted = np.stack([start[a], length[a], checks, tokens[a], places.sequence[run_at] + rank[a] - places.first[run_at], places.offset[run_at]]) if len(a) else np.zeros((6, 0), np.int64)
        cut_rows, cut_owner = [], []
        for i in mine[~fits].tolist():
            n = int(length[i])
            position = int(places.rest[n]) + (int(rank[i]) - int(places.used[n])) * n
            done = 0
            while done < n:
                size = min(n - done, window - (position + done) % window)
                sequence, offset = divmod(position + done, window)
                cut_rows.append((int(start[i]) + done, size, zlib.crc32(rest[i][4 * done : 4 * (done + size)]), int(tokens[i]), places.sequences + sequence, offset))
                cut_owner.append(i)
                done += size
        cut = np.array(cut_rows, np.int64).reshape(-1, 6).T
        values = np.concatenate([whole, fitted, cut], axis=1).astype(np.int64)
        owners = np.concatenate([owner, a, np.array(cut_owner, np.int64)]).astype(np.int64)
        ids = batch.column("doc_id").take(pa.array(owners))
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, values)], names)

    return ranked.mapInArrow(run, schema)


def _search(places: Plan, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The run of places that holds each (length, rank); -1 for leftovers."""
    order = np.lexsort((rank, length))
    n, r = length[order].astype(np.int64), rank[order]
    lows, highs = np.searchsorted(places.length, n, "left"), np.searchsorted(places.length, n, "right")
    found = np.empty(len(n), np.int64)
    for value in np.unique(n).tolist():
        own = slice(np.searchsorted(n, value, "left"), np.searchsorted(n, value, "right"))
        low, high = lows[own.start], highs[own.start]
        found[own] = low + np.searchsorted(places.first[low:high], r[own], "right") - 1
    out = np.empty(len(n), np.int64)
    out[order] = np.where(r < places.used[n], found, -1)
    return out
