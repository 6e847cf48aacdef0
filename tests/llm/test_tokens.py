import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import bpe, bpe_codec, packing, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

BYTE, WORD = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))
SIGNS = list("aeiourstlnTHE'sdm0123 \t\n\r.,!?-_éÈßñ中文αΣςİı½²Ⅳ\x1c\x85　​é🙂👍🏽ﬁ")


@pytest.fixture(scope="module")
def texts():
    found = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    random.seed(1)
    found += ["".join(random.choices(SIGNS, k=random.randint(0, 40))) for _ in range(1500)]
    return found + ["a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> c<|endoftext|>", "x" * 3000, "  \n\n  x  ", "don't WE'RE 's", "word " * 40_000, "", None]


def test_round_trip_equals_the_library(texts, make_docs):
    library = Tokenizer.from_file(WORD)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in bpe_codec.round_trip(make_docs(rows), WORD).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def every_code_point():
    points = [i for i in [*range(0x20000), *range(0x2F7F0, 0x2FA20), *range(0x31340, 0x323C0), *range(0xE0000, 0xE01F0)] if not 0xD800 <= i < 0xE000]
    for i in points:
        yield f"a{chr(i)}b 1{chr(i)}"
    for low in range(0, len(points), 50):
        yield "".join(map(chr, points[low : low + 50]))


def awkward_texts(n):
    """Marks out of order, letters of many scripts, and what one version of Unicode knows and another doesn't."""
    draw = random.Random(4)
    marks = [*range(0x300, 0x370), *range(0x591, 0x5C0), *range(0x610, 0x61B), *range(0x64B, 0x660), *range(0x890, 0x8A0), *range(0x8D0, 0x900), *range(0x1DC0, 0x1E00), *range(0x2DE0, 0x2E00), 0x3099, 0x1CF9, 0x10EFD, 0x1E08F]
    letters = [*range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7DD), *range(0xAC00, 0xAC20), *range(0x1100, 0x1120), *range(0x1160, 0x1180), 0x130, 0x1E9E, 0x2126, 0x212B, 0x105C0]
    others = [0x20, 0x20, 0x9, 0xA, 0xA0, 0x1680, 0x2003, 0x3000, 0x85, 0x1C, 0x27, 0x31, 0x661, 0x2167, 0xBD, 0x2E, 0x5F, 0x1F600]
    for _ in range(n):
        yield "".join(chr(draw.choice(draw.choice((letters, letters, marks, others)))) for _ in range(draw.randrange(1, 12)))


@pytest.mark.parametrize("path, encoder", [(WORD, bpe_codec.encoder), (BYTE, bpe_codec.encoder), (BYTE, packing.encoder)])
def test_every_code_point_and_marks_out_of_order(path, encoder):
    library, own = Tokenizer.from_file(path), encoder(path)
    texts = [*every_code_point(), *awkward_texts(40_000)]
    for low in range(0, len(texts), 20_000):
        part = texts[low : low + 20_000]
        for text, ids, found in zip(part, own.encode(part), library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == found.ids, ascii(text)


def test_counts_of_every_code_point():
    library, own = Tokenizer.from_file(BYTE), token_counts.prefix_counts(BYTE)
    texts = [*every_code_point(), *awkward_texts(5_000)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        runs = own.split(text)
        own.learn({w for words, special in runs if not special for w in words})
        assert sum(own.counts(runs)) == len(found.ids), ascii(text)


def test_byte_level_decoding_gives_the_text(make_docs):
    rows = [(1, "Hello  world<|endoftext|>\n é🙂"), (2, None), (2, None)]
    got = bpe_codec.decode(bpe_codec.encode(make_docs(rows), BYTE), BYTE).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, rows[0][1]), (2, ""), (2, "")]


def test_counts_equal_the_library(texts, make_docs):
    library = Tokenizer.from_file(BYTE)
    rows = list(enumerate(texts))
    for r in token_counts.token_counts(make_docs(rows), BYTE, 64).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 64)
        counts = token_counts.prefix_counts(BYTE).of_prefixes(text)
        assert counts[-1] == n and len(counts) == r.n_bytes + 1
        fits = [i for i in np.flatnonzero(counts <= 64) if i == r.n_bytes or text.encode()[i] & 0xC0 != 0x80]
        assert r.fit_bytes <= fits[-1] and counts[r.fit_bytes] <= 64
    assert token_counts.token_counts(make_docs(rows).limit(0), BYTE).collect() == []


def test_prefix_counts_of_a_word_are_exact():
    library = Tokenizer.from_file(BYTE)
    counts = token_counts.prefix_counts(BYTE).of_prefixes("internationalisation")
    assert counts.tolist() == [len(library.encode("internationalisation"[:i]).ids) for i in range(21)]


def test_pairs_stand_together_exactly_if_the_merges_say_so():
    v = bpe.vocabulary(WORD)
    random.seed(3)
    ids = random.sample(sorted(v.inner.values()), 400)

    def merged(parts):
        parts = list(parts)
        while True:
            best = min(((v.merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in v.merges), default=None)
            if best is None:
                return parts
            (_, token), i = best
            parts[i : i + 2] = [token]

    for a, b in zip(ids, reversed(ids)):
        if v.edges(a) and v.edges(b):
            assert v.may_follow(a, b) == (merged(v.symbols[a] + v.symbols[b]) == [a, b])


def test_a_small_word_table_starts_anew(monkeypatch, make_docs):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    table = token_counts.PrefixCounts(BYTE)
    for text in ("one two three four five", "six seven", "one two"):
        runs = table.split(text)
        table.learn({w for ws, _ in runs for w in ws})
        assert sum(table.counts(runs)) == len(Tokenizer.from_file(BYTE).encode(text).ids)


def test_an_inner_prefix_may_have_more_tokens_than_fit_a_byte(make_docs):
    library = Tokenizer.from_file(BYTE)
    runs = ["A" * 2040, "x" * 2040, *("0" * n for n in range(4066, 4071)), "A" * 2033, "A" * 2048, "x" * 2047]
    counts = token_counts.prefix_counts(BYTE).of_prefixes(runs[0])
    assert counts[-1] < 256 <= counts.max()
    for r in token_counts.token_counts(make_docs(list(enumerate(runs))), BYTE, 64).collect():
        assert r.n_tokens == len(library.encode(runs[r.doc_id]).ids)


def odd(spark):
    names = ["ids", "text_sha256", "n_tokens", "body", "n_bytes", "a.b"]
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (None, None), (2, ""), (3, "word " * 30_000)]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(*r, *names) for r in rows], schema), rows


def test_odd_rows_and_clashing_names(spark):
    docs, rows = odd(spark)
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    size = lambda library, text: len(library.encode(text or "", add_special_tokens=False).ids)
    order = lambda found: sorted(found, key=str)
    assert order((r.doc_id, r.n_tokens) for r in bpe_codec.round_trip(docs, WORD).collect()) == order((i, size(word, t)) for i, t in rows)
    assert order((r.doc_id, r.n_tokens, r.n_bytes) for r in token_counts.token_counts(docs, BYTE).collect()) == order((i, size(byte, t), len(t or "")) for i, t in rows)
    assert bpe_codec.round_trip(docs.limit(0), WORD).collect() == []


def test_what_fits_is_not_cut_short(make_docs):
    """Of plain words, whose prefixes only grow in tokens, the longest prefix within the limit is found."""
    rows = [(i, " ".join(["internationalisation", "of", "words"] * n)) for i, n in enumerate((1, 5, 40, 200))]
    for r in token_counts.token_counts(make_docs(rows), BYTE, 64).collect():
        counts = token_counts.prefix_counts(BYTE).of_prefixes(rows[r.doc_id][1])
        assert r.fit_bytes == np.flatnonzero(counts <= 64)[-1]
