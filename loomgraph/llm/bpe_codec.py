"""BPE encoding by a walk over the trie of distinct words, and decoding.

Each task inserts the distinct words of some MB of text into a trie (kept as sorted words: a word's
shared prefix with the one before it is the path that both have), walks it depth first with the last
token of each prefix as its state, and joins the words' ids back into the texts' ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe
from loomgraph.llm.common import bodies, with_bytes


class Encoder:
    """Ids, as little-endian unsigned 32-bit integers, of the words seen so far."""

    def __init__(self, path: str):
        self.vocabulary = bpe.vocabulary(path)
        self.split_words = bpe.lower_case_words if self.vocabulary.end else bpe.byte_level_words
        self.table: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.table}
        if len(new) + len(self.table) > bpe.CACHE_WORDS:
            self.table.clear()
            new = words
        for word, ids, _ in self.vocabulary.walk(sorted(map(str.encode, new))):
            self.table[word.decode()] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = []
        for text in texts:
            parts = bpe.around_special(text, self.vocabulary.special)
            runs.append([[p] if i % 2 else self.split_words(p) for i, p in enumerate(parts)])
        self.learn({w for parts in runs for words in parts[::2] for w in words})
        get, special = self.table.__getitem__, self.vocabulary.special
        return [
            b"".join([b"".join(map(get, words)) if i % 2 == 0 else np.array(special[words[0]], "<u4").tobytes() for i, words in enumerate(parts)])
            for parts in runs
        ]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids``: the tokens of each whole text as little-endian unsigned 32-bit integers.

    Null texts count as empty and have no ids. Special tokens within a text are one id, as in the
    file's library. Rows stay as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path)
        for batch in batches:
            at, first, size, texts = 0, 0, 0, []
            for body in bodies(batch.column(1)):
                texts.append(body.decode())
                size += len(body)
                at += 1
                if size > 2_000_000 or at == batch.num_rows:
                    ids = pa.array(table.encode(texts), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), ids], ["doc_id", "ids"])
                    first, size, texts = at, 0, []

    source = with_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return source.mapInArrow(run, "doc_id long, ids binary")


def decoded(ids: bytes, path: str) -> str:
    """Tokens joined by spaces where words end in a mark, else the text of their bytes."""
    vocabulary = bpe.vocabulary(path)
    tokens = map(vocabulary.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
    if vocabulary.end:
        return " ".join(tokens)
    back = {c: b for b, c in enumerate(bpe.byte_characters())}
    out = [t.encode() if t in vocabulary.special else bytes(back[c] for c in t) for t in tokens]
    return b"".join(out).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with the decoded ``text``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([decoded(ids, path) for ids in bodies(batch.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["doc_id", "ids", "text"])

    source = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return source.mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of what ``encode`` gives and of what ``decode`` makes of it: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row per row of ``docs``: null texts count as empty, repeated rows and null doc_ids stay as they
    are, an empty table gives none, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(bodies(batch.column(1)))
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decoded(x, path).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
