import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """By the libraries on whole texts, a character offset at a time."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = alignment.side(A).bytes, alignment.side(B).bytes
    found = []
    for doc_id, text in rows:
        body = b" " + (text or "").encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        if b"".join(a_bytes[i] for i in a) != body or b"".join(b_bytes[i] for i in b) != body:
            a = b = []
        at, ends_b = 0, {}
        for k, i in enumerate(b):
            at += len(b_bytes[i])
            ends_b[at] = k + 1
        groups, at, low_a, low_b = [], 0, 0, 0
        for k, i in enumerate(a):
            at += len(a_bytes[i])
            if at in ends_b:
                groups.append((a[low_a : k + 1], b[low_b : ends_b[at]]))
                low_a, low_b = k + 1, ends_b[at]
        found.append((doc_id, a, b, groups))
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for _, _, _, groups in found]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, a, b, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n_best = sum(n for p, n in own.items() if count[p] == best[p[0]])
        out.append((doc_id, len(a), len(b), len(groups), sum(own.values()), n_best, sum(n * count[p] for p, n in own.items()), sha))
    return out


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "the the the quick", "", None, " ", "   ", "a", " leading and trailing ",
    "two  spaces and   three\n\nlines\n next\t tab", "Größe für alle, naïve façade. L'été d'où l'on vient", "日本語のテキスト 日本語", "\U0001f600 \U0001f469‍\U0001f469 ok",
    "literal ▁ stroke", "special <|endoftext|> and <s> and <unk> text", "don't we'll 's 12345 67,8.90", "x" * 3000, "é combininǵ marks",
    " non breaking   wide ​ zero", "end\r\n", "Word,word;x.y ... a,b!?.c 3.14,15 ,lead :-) a_,b ².c Ünï.é, it's.", "nul\x00 byte \x1c sep", "The quick brown fox jumps over the lazy dog.", "word " * 500,
]


@pytest.mark.parametrize("stretch", [3, alignment.STRETCH])
def test_equals_the_libraries_on_whole_texts(spark, make_docs, monkeypatch, stretch):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    rows = [*enumerate(TEXTS), (3, "the same id again"), (None, "no id"), (None, None)]
    got = alignment.align(make_docs(rows), A, B).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = alignment.align(docs, A, B).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_words_are_encoded_alone_as_in_the_text(monkeypatch):
    """Random texts of awkward characters; the table of words overflows all the time."""
    monkeypatch.setattr(alignment, "CACHE_WORDS", 50)
    known = alignment.Known((alignment.side(A), alignment.side(B)))
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    draw = random.Random(2)
    pieces = ["a", "the", " ", " ", " ", ",", ".", ";", "!", "?", ":", "\n", "\t", "'s", "_", "1", "42", "é", "ß", "\u4e2d", "\u0301", "-", '"', "(", "\u00d7", "\u200b", "Qu", "ion"]
    assert known.signs == ",.;:!?"
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randrange(1, 30)))
        words = alignment.stretches(text, known.signs)
        assert "".join(words) == " " + text
        known.learn(set(words))
        index = np.array([known.index[w] for w in words])
        if known.right[index].all():
            assert known.ids(0, index)[0].tolist() == t.encode(" " + text, add_special_tokens=False).ids, text
            assert known.ids(1, index)[0].tolist() == s.encode(text), text


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert alignment.align(make_docs([(1, "a")]).limit(0), A, B).collect() == []
    docs = make_docs([(1, "a b"), (2, None)])
    for name in ("row", "at", "side", "ids", "body", "block", "n_a", "totals"):
        docs = docs.withColumn(name, docs.doc_id)
    assert sorted(r.n_a for r in alignment.align(docs, A, B).collect()) == [0, 2]
