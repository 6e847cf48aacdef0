"""Token counts by prefix dynamic programming.

The count of a prefix is the count of the prefix before its last token plus one, so one walk over a
word gives the count of each of its prefixes. With these tables a text's count, the longest prefix
within a budget and the count at any cut are sums and look-ups; nothing is encoded again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe
from loomgraph.llm.common import bodies, with_bytes

_total = itemgetter(-1)


class PrefixCounts:
    """Counts of every prefix of the words seen so far."""

    def __init__(self, path: str):
        self.vocabulary = bpe.vocabulary(path)
        self.table: dict[str, bytes | tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.table}
        if len(new) + len(self.table) > bpe.CACHE_WORDS:
            self.table.clear()
            new = words
        for word, _, counts in self.vocabulary.walk(sorted(map(str.encode, new))):
            own = counts[1 : len(word) + 1]
            self.table[word.decode()] = bytes(own) if max(own) < 256 else tuple(own)

    def split(self, text: str) -> list[tuple[list[str], bool]]:
        """Runs of words, and special tokens (marked) between them."""
        parts = bpe.around_special(text, self.vocabulary.special)
        return [([p], True) if i % 2 else (bpe.byte_level_words(p), False) for i, p in enumerate(parts)]

    def counts(self, runs: list[tuple[list[str], bool]]) -> list[int]:
        out: list[int] = []
        for words, special in runs:
            out += [1] if special else map(_total, map(self.table.__getitem__, words))
        return out

    def longest_within(self, runs: list[tuple[list[str], bool]], budget: int) -> int:
        """Bytes of the longest prefix, whole characters only, with at most ``budget`` tokens.

        Words are those of the whole text; the last of them may be cut.
        """
        sums = list(accumulate(self.counts(runs)))
        n = bisect_right(sums, budget)
        words = [(w, s) for ws, s in runs for w in ws]
        size = sum(len(w.encode()) for w, _ in words[:n])
        if n == len(words) or words[n][1]:
            return size
        left, body = budget - (sums[n - 1] if n else 0), words[n][0].encode()
        fits = [i + 1 for i, c in enumerate(self.table[words[n][0]]) if c <= left]
        cut = max((i for i in fits if i == len(body) or body[i] & 0xC0 != 0x80), default=0)
        return size + cut

    def of_prefixes(self, text: str) -> np.ndarray:
        """The token count of each prefix of the text in bytes, with the words of the whole text."""
        runs = self.split(text)
        self.learn({w for ws, special in runs if not special for w in ws})
        out, base = [0], 0
        for words, special in runs:
            for w in words:
                own = [1] * len(w.encode()) if special else self.table[w]
                out += [base + c for c in own]
                base += own[-1]
        return np.array(out)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_bytes``, the bytes that fit ``limit``.

    Null texts count as empty: no bytes, no tokens. Rows stay as they are, repeated or with a null
    doc_id; other columns are not read. ``path`` names the vocabulary file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_counts(path)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            waiting: list[tuple[int, list]] = []
            size = 0
            for body in bodies(batch.column(1)):
                waiting.append((len(body), table.split(body.decode())))
                size += len(body)
                if size > 2_000_000:
                    rows += finish(table, waiting)
                    waiting, size = [], 0
            rows += finish(table, waiting)
            n = np.array(rows, np.int64).reshape(-1, 3)
            columns = [batch.column(0), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 1] > limit), pa.array(n[:, 2])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    def finish(table: PrefixCounts, waiting: list[tuple[int, list]]) -> list[tuple[int, int, int]]:
        table.learn({w for _, runs in waiting for words, special in runs if not special for w in words})
        out = []
        for n_bytes, runs in waiting:
            n = sum(table.counts(runs))
            out.append((n_bytes, n, n_bytes if n <= limit else table.longest_within(runs, limit)))
        return out

    source = with_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
