"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

The n-grams of every order are counted in tables partitioned by hash; each block's n-grams are joined
to the tables, a document's own occurrences are taken off, and the logarithms are summed per document.
The number of words of the corpus is the count of the n-gram of order 0.

An n-gram is known by a 64-bit hash of its words, which its table keeps whole. Rows of
single n-grams would be some ten times the input; a block's distinct n-grams of one bucket are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import NO_ID, Block, buckets_for, counted, distinct_keys, lists, make_blocks, read_blocks, totals_of

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a block, and of those hashed at once. Larger blocks repeat fewer n-grams.
BLOCK_BYTES, PIECE = 8 << 20, 1 << 20
#: Count of a word that no other document has.
UNSEEN = 0.5
# Odd multipliers of 64 bits, and the inverse of the first one.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_A_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Grams(NamedTuple):
    doc: np.ndarray  # of each word
    rank: np.ndarray  # of each word within its document
    keys: list[np.ndarray]  # by order: the hash of the n-gram that ends at each word


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h = h * _B
    return h ^ h >> np.uint64(29)


def _word_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Differences of prefix sums of byte times power, moved back to power 0, hash each word."""
    out = np.empty(len(start), np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(text) + PIECE, PIECE))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if i == j:
            continue
        low = start[i]
        piece = _LOWER[text[low : stop[j - 1]]].astype(np.uint64) + np.uint64(1)
        powers = np.multiply.accumulate(np.full(len(piece), _A))
        sums = np.r_[np.uint64(0), np.cumsum(piece * powers)]
        back = np.multiply.accumulate(np.full(len(piece), _A_BACK))
        first, last = start[i:j] - low, stop[i:j] - low
        out[i:j] = _mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return out


def grams(block: Block, order: int) -> Grams:
    """The n-grams of a block; words are runs of bytes other than 20 and 09-0D (hex), A-Z lower-cased."""
    space = np.r_[_SPACE[block.text], True]
    begins = ~space[:-1] & np.r_[True, space[:-2]] if len(block.text) else np.zeros(0, bool)
    full = block.starts[block.starts < block.ends]
    begins[full] = ~space[full]
    stops = ~space[:-1] & space[1:]
    last = block.ends[block.starts < block.ends] - 1
    stops[last] = ~space[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    word = _word_hashes(block.text, start, stop)
    doc = np.searchsorted(block.ends, start, "right")
    rank = np.arange(len(start)) - np.searchsorted(doc, doc, "left")
    keys = [np.zeros(len(start), np.uint64), word]
    for n in range(2, order + 1):
        longer = np.zeros(len(start), np.uint64)
        longer[1:] = _mix(keys[-1][:-1] * _A + word[1:] + np.uint64(n))
        keys.append(longer)
    return Grams(doc, rank, keys)


def asked(found: Grams) -> np.ndarray:
    """The keys of all n-grams within one document, by order."""
    return np.concatenate([k[found.rank >= n - 1] for n, k in enumerate(found.keys)])


def others(found: Grams, totals: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """By order, the count of each word's n-gram in all other documents; -1 where there is none."""
    out, at = [], 0
    for n, keys in enumerate(found.keys):
        has = np.flatnonzero(found.rank >= n - 1)
        own = place[at : at + len(has)]
        at += len(has)
        _, pair, times = np.unique(found.doc[has] * (len(totals) + 1) + own, return_inverse=True, return_counts=True)
        count = np.full(len(keys), -1, np.int64)
        count[has] = totals[own].astype(np.int64) - times[pair]
        out.append(count)
    return out


def word_scores(counts: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of each word's score, and how many orders it backed off."""
    words = len(counts[0])
    best = np.sum([c >= 0 for c in counts[1:]], axis=0)  # the highest order that a word has a history for
    score, level = np.zeros(words), np.zeros(words, np.int64)
    for n in range(1, len(counts)):
        history = counts[0] if n == 1 else np.r_[0, counts[n - 1][:-1]]
        seen = np.flatnonzero(counts[n] > 0 if n > 1 else counts[n] >= 0)
        score[seen] = np.log(np.maximum(counts[n][seen], UNSEEN)) - np.log(np.maximum(history[seen], 1))
        level[seen] = n
    return score + (best - level) * np.log(alpha), best - level


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_backoff, log_score.

    A word's score is the share of its longest history's occurrences, in other rows, that the word
    follows; each order given up costs the factor ``alpha``. A word that no other row has counts
    ``UNSEEN`` times. Histories begin with the document. ``n_backoff`` is the number of words that gave
    up an order or more. Null and empty texts have no words and score 0. Repeated rows vouch for each
    other; null doc_ids are kept; other columns are not read.
    """
    blocks = make_blocks(docs, BLOCK_BYTES, level=9)
    buckets = buckets_for(blocks, 0.3)
    answered = counted(blocks, lambda block: asked(grams(block, order)), buckets, whole=True)
    schema = "doc_id long, n_words long, n_backoff long, log_score double"

    def scored(block: Block, parts: list[dict]) -> pa.RecordBatch:
        found = grams(block, order)
        counts = others(found, totals_of(parts), distinct_keys(asked(found), buckets, whole=True).place)
        logs, gave_up = word_scores(counts, alpha)
        n = len(block.ids)
        columns = [
            pa.array(block.ids, mask=block.ids == NO_ID),
            pa.array(np.bincount(found.doc, minlength=n)),
            pa.array(np.bincount(found.doc, gave_up > 0, minlength=n).astype(np.int64)),
            pa.array(np.bincount(found.doc, logs, minlength=n).astype(np.float64)),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's arrays end with the call, before the next block's are made.
        for batch in batches:
            for block, parts in zip(read_blocks(batch), lists(batch, "totals")):
                yield scored(block, parts)

    return answered.mapInArrow(run, schema).withColumn("log_score", F.round("log_score", 4))
