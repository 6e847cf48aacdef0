import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

BYTE, WORD = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))


def verify(rows, got, window):
    library = Tokenizer.from_file(BYTE)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(own)
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
        lengths.append(at)
    assert sum(n != window for n in lengths) <= 1
    return sum(map(len, ids.values())), len(lengths)


@pytest.mark.parametrize("window", [16, 1024])
def test_every_id_lies_in_one_piece_and_sequences_are_full(make_docs, window):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab c.\n", k=rng.randint(0, 80 if window == 16 else 6000)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 20_000), (1003, "a<|endoftext|>b"), (1004, "é🙂")]
    total, sequences = verify(rows, packing.pack(make_docs(rows).repartition(3), BYTE, window).collect(), window)
    assert sequences == -(-total // window)


def test_empty_table_and_repeated_rows(spark, make_docs):
    assert packing.pack(make_docs([(1, "a")]).limit(0), BYTE).collect() == []
    frame = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2)], "doc_id long, text string, rank int")
    got = packing.pack(frame, BYTE).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 3


def test_plan_uses_each_remainder_once_and_prefers_exact_fills():
    rng = np.random.default_rng(0)
    for histogram in (rng.integers(0, 5000, 1024), np.where(np.arange(1024) % 256 == 0, 10**12, 0), np.zeros(1024, int)):
        histogram[0] = 0
        p = packing.plan(histogram)
        assert (p.used <= histogram).all()
        left = ((histogram - p.used) * np.arange(1024)).sum()
        assert left <= 0.3 * (histogram * np.arange(1024)).sum()
        assert p.sequences * 1024 == (p.used * np.arange(1024)).sum()


def test_least_squares_is_not_negative_and_fits():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 2, (30, 20)).astype(float)
    x = np.maximum(rng.normal(size=20), 0)
    got = packing.solve(matrix, matrix @ x)
    assert (got >= 0).all() and np.abs(matrix @ got - matrix @ x).max() < 0.05


class Counting:
    """A library that counts the texts it is given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_the_library_gets_many_new_words_as_one_text():
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnopqrst" for c in ("ing", "ed.", "é", "'s,", "12")]
    text, own = " ".join(words), packing.LibraryEncoder(BYTE)
    own.library = Counting(own.library)
    for _ in range(2):
        ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert ids == own.library.library.encode(text, add_special_tokens=False).ids
    assert own.library.texts < len(words) / 20


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_white_space_of_any_kind_and_special_tokens(path):
    rng = random.Random(5)
    signs = [" ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\u3000", "a", "B", "é", "中", "1", ".", "'s", "'", "\u0301", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(20_000)]
    library, own = Tokenizer.from_file(path), packing.LibraryEncoder(path)
    for low in range(0, len(texts), 3000):
        part = texts[low : low + 3000]
        for text, ids, found in zip(part, own.encode(part), library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == found.ids, ascii(text)


@pytest.mark.parametrize("bound", ["CACHE_WORDS", "CACHE_CHARACTERS"])
def test_a_small_table_of_stretches_starts_anew(monkeypatch, bound):
    monkeypatch.setattr(packing, bound, 1)
    library, own = Tokenizer.from_file(BYTE), packing.LibraryEncoder(BYTE)
    for texts in (["one two three four five"], [], ["", "six seven", "six seven"], ["one two"]):
        found = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)] == found
    assert len(own.numbers) == 2


def test_tokens_that_drop_bytes_are_encoded_stretch_by_stretch():
    own = packing.LibraryEncoder(BYTE)
    text = "some words, and more of them"
    expected = own.library.encode(text, add_special_tokens=False).ids
    own.token_bytes[expected[2]] -= 1
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == expected
