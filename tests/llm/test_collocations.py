import random
import re
from collections import Counter

import pytest

from loomgraph.llm import collocations as col


def brute(rows, longest, top=2000):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(found[i : i + m])) for i in range(len(found) - m + 1))
    frequent = {k: n for k, n in counts.items() if n >= 10 and len(k[1]) > 1}
    out = {}
    for (lang, p), a in frequent.items():
        if any(k == lang and len(q) > len(p) and 100 * n >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (k, q), n in frequent.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(rows)


def made(seed, n=120):
    draw, rows = random.Random(seed), []
    vocabulary = ["the", "of", "New", "york", "CITY", "é", "Über", "a-b", "x", "日本"] + [f"w{i}" for i in range(30)]
    for i in range(n):
        words = []
        while len(words) < 60:
            words += draw.choice([["New", "York", "City"], ["of", "the"], ["the", "the", "the"], [draw.choice(vocabulary)]])
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "!? "]) for w in words)
        rows.append((text, draw.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("  .,;\n", "fr"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize("seed, longest, chunk, bits", [(1, 3, 8 << 20, 28), (2, 3, 500, 28), (3, 4, 2000, 28), (4, 3, 2000, 6), (5, 2, 2000, 28)])
def test_equals_brute_force(spark, monkeypatch, seed, longest, chunk, bits):
    """Small chunks, and a bitmap of 64 bits that takes nearly everything for frequent, change nothing."""
    monkeypatch.setattr(col, "CHUNK", chunk)
    monkeypatch.setattr(col, "BITS", bits)
    rows = made(seed)
    got = col.collocations(frame(spark, rows), longest=longest).collect()
    assert sorted(map(tuple, got)) == brute(rows, longest)


def test_top_by_shares(spark):
    rows = made(6)
    got = col.collocations(frame(spark, rows), top=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 7)


def test_arithmetic_past_64_bits(spark):
    n = 4 * 10**12
    words = spark.createDataFrame([("en", "a", n + 3), ("en", "b", n + 7)], "lang string, phrase string, a long")
    phrases = spark.createDataFrame([("en", 2, "a b", n)], "lang string, size int, phrase string, a long")
    row = col.scored(words, phrases, 2).first()
    assert (row.l, row.r, row.score) == (n + 3, n + 7, 1000000 * n * n // ((n + 3) * (n + 7)))


def test_empty_table_and_clashing_columns(spark):
    rows = [("the cat sat. " * 12, "en")]
    docs = frame(spark, rows)
    assert col.collocations(docs.limit(0)).collect() == []
    for name in ("phrase", "a", "n", "key", "body", "share", "rank"):
        docs = docs.withColumn(name, docs.doc_id)
    assert [tuple(r) for r in col.collocations(docs).collect()] == brute(rows, 3)
