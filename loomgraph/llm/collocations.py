"""Phrase collocations by level-wise (Apriori) passes over the texts.

Level 1 counts words. For each further level the frequent phrases of the level before are broadcast as
a bitmap of their hashes, and a task hands on only phrases whose first words and whose last words are
both in it. Hashes are counted first; only phrases whose hash is frequent travel as text and are
counted once more, exactly. So a bitmap that takes too much for frequent costs time and changes
nothing, and its size is bounded (``BITS``) whatever the number of phrases.

Cuts are scored from the level tables: a phrase takes over from its first words' row the counts of all
its beginnings, and from its last words' row those of all its endings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bodies, join_counted, saved, shuffle_partitions

LONGEST, FREQUENT, TOP = 3, 10, 2000
#: Bytes of text that are counted before rows go on, and those of all languages that wait for more.
CHUNK, WAITING = 8 << 20, 24 << 20
#: The largest bitmap, as a power of two of its bits (32 MB); smaller ones have 16 bits or more for each phrase.
BITS = 28
# Odd multipliers of 64 bits.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

# What ends a word (1), and what ends a piece as well (2).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words(NamedTuple):
    """The words of a chunk of texts of one language."""

    ids: np.ndarray  # of each word in ``names``
    names: pa.Array  # distinct words
    piece: np.ndarray  # of each word


def words_of(text: bytes) -> Words:
    """Words of texts (joined by a line feed, which ends pieces) after A-Z are lower-cased."""
    raw = np.frombuffer(text.lower(), np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    offsets = np.r_[0, np.cumsum(stop - start)].astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    return Words(found.indices.to_numpy().astype(np.int64), found.dictionary, np.cumsum(kind == 2)[start])


def word_keys(names: pa.Array, lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist(), repeat(seed)), np.uint64, len(names))


def _longer(keys: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """Keys of phrases of ``size`` words, from those of their first words and of the words."""
    n = max(len(word) - size + 1, 0)
    h = keys[:n] * _A + word[size - 1 :] + np.uint64(size)
    h ^= h >> np.uint64(32)
    h *= _B
    return h ^ h >> np.uint64(29)


class Bitmap(NamedTuple):
    power: int
    words: np.ndarray  # uint64

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> np.uint64(64 - self.power)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def bitmap(keys: DataFrame) -> Bitmap:
    """Bits of all ``key`` values; at most ``BITS`` decide the size of what comes to the driver."""
    power = min(BITS, max(16, math.ceil(math.log2(16 * max(keys.count(), 1)))))
    bit = F.shiftrightunsigned("key", 64 - power)
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    found = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(1 << (power - 6), np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bitmap(power, words)


def frequent_phrases(found: Words, lang: str, levels: list[Bitmap], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where phrases of ``size`` words begin whose first and last words are frequent, and their keys.

    ``levels`` are the bitmaps of phrases of 1, 2, ... words.
    """
    word = word_keys(found.names, lang)[found.ids]
    keys = word
    for n in range(2, size):
        keys = _longer(keys, word, n)
    known = levels[size - 2].has(keys)
    keys = _longer(keys, word, size)
    n = len(keys)
    at = np.flatnonzero(known[:n] & known[1 : n + 1] & (found.piece[:n] == found.piece[size - 1 :])) if n else np.zeros(0, np.int64)
    return at, keys[at]


Emit = Callable[[str, Words], pa.RecordBatch]


def per_chunk(docs: DataFrame, emit: Emit, schema: str) -> DataFrame:
    """``emit`` of each chunk of texts of one language; a null language is ``und``, a null text empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            size.pop(lang)
            return emit(lang, words_of(b"\n".join(held.pop(lang))))

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), bodies(batch.column(1))):
                held.setdefault(lang, []).append(body)
                size[lang] = size.get(lang, 0) + len(body) + 1
                if size[lang] >= CHUNK:
                    yield flush(lang)
                elif sum(size.values()) >= WAITING:
                    yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    return source.mapInArrow(run, schema)


def _as_text(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()) if len(column) else pa.array([], pa.string())


def word_table(docs: DataFrame) -> DataFrame:
    """lang, phrase, a of every word; the row without a phrase has the number of all words."""

    def emit(lang: str, found: Words) -> pa.RecordBatch:
        n = np.bincount(found.ids, minlength=len(found.names))
        phrases = pa.concat_arrays([_as_text(found.names), pa.array([None], pa.string())])
        counts = np.r_[n, len(found.ids)].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases, pa.array(counts)], ["lang", "phrase", "a"])

    rows = per_chunk(docs, emit, "lang string, phrase string, a long")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def key_table(docs: DataFrame, levels: list[Bitmap], size: int) -> DataFrame:
    """``key`` of phrases of ``size`` words that occur ``FREQUENT`` times by their hash."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def emit(lang: str, found: Words) -> pa.RecordBatch:
        keys, n = np.unique(frequent_phrases(found, lang, shared.value, size)[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    rows = per_chunk(docs, emit, "key long, n int")
    return rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).select("key")


def phrase_table(docs: DataFrame, levels: list[Bitmap]) -> DataFrame:
    """lang, size, phrase, a of phrases of two words or more that occur ``FREQUENT`` times, counted by their text."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def emit(lang: str, found: Words) -> pa.RecordBatch:
        out = []
        for size in range(2, len(levels) + 1):
            at, keys = frequent_phrases(found, lang, shared.value, size)
            at = at[shared.value[size - 1].has(keys)]
            # Equal words have equal numbers within a chunk, so numbers of phrases are exact.
            number = found.ids[at]
            for k in range(1, size):
                _, number = np.unique(number * len(found.names) + found.ids[at + k], return_inverse=True)
            _, first, n = np.unique(number, return_index=True, return_counts=True)
            parts = [_as_text(found.names.take(pa.array(found.ids[at[first] + k]))) for k in range(size)]
            phrases = pc.binary_join_element_wise(*parts, " ")
            out.append((phrases, n, np.full(len(n), size, np.int32)))
        phrases = pa.concat_arrays([p for p, _, _ in out])
        n, sizes = np.concatenate([n for _, n, _ in out]), np.concatenate([s for _, _, s in out])
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(sizes), phrases, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "a"])

    rows = per_chunk(docs, emit, "lang string, size int, phrase string, a long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= FREQUENT)


def level_tables(docs: DataFrame, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, phrase, a), frequent phrases (lang, size, phrase, a), and all words by lang (n)."""
    counts = saved(word_table(docs).filter((F.col("a") >= FREQUENT) | F.col("phrase").isNull()), "phrases-words")
    words = counts.filter("phrase IS NOT NULL")
    levels = [bitmap(_keys(words))]
    for size in range(2, longest + 1):
        levels.append(bitmap(saved(key_table(docs, levels, size), "phrases-keys")))
    totals = counts.filter("phrase IS NULL").select("lang", F.col("a").alias("n"))
    return words, saved(phrase_table(docs, levels), "phrases-longer"), totals


def _keys(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in batch.column(0).unique().to_pylist()}
            keys = map(xxhash.xxh64_intdigest, bodies(batch.column(1)), map(seeds.__getitem__, batch.column(0).to_pylist()))
            keys = np.fromiter(keys, np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return words.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "key long")


def scored(words: DataFrame, phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``phrases`` with l, r and score of the lowest-scoring cut, without those that a longer phrase stands for."""
    # begins and ends: how often the first and the last 1, 2, ... words occur.
    none = F.array().cast("array<long>")
    before, out = words.select("lang", "phrase", "a", none.alias("begins"), none.alias("ends")), []
    for size in range(2, longest + 1):
        rows = phrases.filter(F.col("size") == size).select(
            "lang", "phrase", "a",
            F.substring_index("phrase", " ", size - 1).alias("head"), F.substring_index("phrase", " ", 1 - size).alias("tail"),
        )
        # A phrase has no more longer ones than occurrences: hot phrases are told by their count.
        heads = before.select("lang", F.col("phrase").alias("head"), F.col("a").alias("n"), F.concat("begins", F.array("a")).alias("begins"))
        tails = before.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("n"), F.concat("ends", F.array("a")).alias("ends"))
        rows = join_counted(join_counted(rows, heads, ["lang", "head"]).drop("n"), tails, ["lang", "tail"]).drop("n")
        before = saved(rows, "phrases-level")
        out.append(before)
    kept = [out[-1].drop("head", "tail")]
    for rows, longer in zip(out, out[1:]):
        inside = longer.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
        most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        alone = rows.join(most, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
        kept.append(alone.drop("head", "tail", "longer"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    exact = lambda x: f"cast({x} AS decimal(16, 0))"
    cut = f"""array_min(transform(sequence(1, size(begins)), k -> named_struct(
        'score', 1000000 * {exact("a")} * {exact("a")} div ({exact("begins[k - 1]")} * {exact("ends[size(begins) - k]")}),
        'k', k, 'l', begins[k - 1], 'r', ends[size(begins) - k])))"""
    return rows.withColumn("cut", F.expr(cut)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_phrases(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``; first those of ever larger shares."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = shuffle_partitions(rows.sparkSession)
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)).cast("int"))
    while shares > 1:
        own = Window.partitionBy("lang", "share").orderBy(*order)
        shares = shares // 16 + 1 if shares > 16 else 1
        rows = rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top).withColumn("share", F.pmod("share", F.lit(shares)))
    last = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top).drop("share")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``longest`` words.

    Texts are cut at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs into words, A-Z
    lower-cased. ``a`` counts a phrase within pieces, overlaps included, ``n`` all words of the
    language. Phrases occur ``FREQUENT`` times or more; the score is that of the cut with the least
    floor(1000000 a a / (l r)), ``l`` and ``r`` being the counts of its two sides. A phrase inside a longer
    one that occurs half as often or more is left out. Null texts are empty, a null language is
    ``und``; repeated rows count each time; no other columns are read. A language without frequent
    phrases has no rows.
    """
    words, phrases, totals = level_tables(docs, longest)
    best = best_phrases(scored(words, phrases, longest), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
