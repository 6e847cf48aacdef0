import math
import re
from collections import Counter

import duckdb
import pytest

from loomgraph.llm import blocks, lm_scoring, queries


def want(rows, order=3, alpha=0.4):
    docs = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    grams = lambda ws: Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    all_grams, n_words = sum(map(grams, docs), Counter()), sum(map(len, docs))
    out = []
    for (i, _), ws in zip(rows, docs):
        own, total, gave_up = grams(ws), 0.0, 0
        left = lambda g: all_grams[g] - own[g]
        for k in range(len(ws)):
            top = min(order, k + 1)
            n = next((n for n in range(top, 1, -1) if left(tuple(ws[k - n + 1 : k + 1])) > 0), 1)
            gram = tuple(ws[k - n + 1 : k + 1])
            below = left(gram[:-1]) if n > 1 else n_words - len(ws)
            total += math.log(max(left(gram), 0.5) / max(below, 1)) + (top - n) * math.log(alpha)
            gave_up += n < top
        out.append((i, len(ws), gave_up, total))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


ROWS = [
    (1, "The cat sat on the mat. The cat ran."), (2, "the cat sat on a chair"), (3, "a dog sat on the mat."), (4, None), (5, ""), (6, " \t\n "),
    (7, "the cat sat on a chair"), (8, "é\x1cz É ZZ zz the"), (9, "word " * 30_000), (10, "alone"), (None, "the cat ran"),
]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_against_brute_force(make_docs, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 60)
    got = lm_scoring.score(make_docs(ROWS).repartition(3), order).collect()
    got = sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0))
    for g, w in zip(got, want(ROWS, order), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-3)


@pytest.mark.parametrize("partitions", [5, 100])
def test_counting_in_two_steps(make_docs, monkeypatch, partitions):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 60)
    monkeypatch.setattr(blocks, "BUCKET_KEYS", 1500)  # 31 buckets
    monkeypatch.setattr(blocks, "ONE_STEP", 2)
    monkeypatch.setattr(blocks, "PARTITIONS", partitions)
    got = lm_scoring.score(make_docs(ROWS).repartition(3)).collect()
    got = sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0))
    for g, w in zip(got, want(ROWS), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-3)


def test_sql_gives_the_same(make_docs):
    rows = [r for r in ROWS if r[0]]
    documents = make_docs(rows).toPandas()  # noqa: F841  read by name
    sql = sorted(tuple(r) for r in duckdb.sql(f"SELECT doc_id, n_words, n_backoff, log_score FROM ({queries.OP1_ORACLE})").fetchall())
    got = sorted(tuple(r) for r in lm_scoring.score(make_docs(rows)).collect())
    assert [g[:3] for g in got] == [s[:3] for s in sql]
    assert all(abs(g[3] - s[3]) < 2e-4 for g, s in zip(got, sql))


def test_empty_table_and_extra_columns(spark, make_docs):
    assert lm_scoring.score(make_docs([(1, "a")]).limit(0)).collect() == []
    frame = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2)], "doc_id long, text string, totals int")
    got = lm_scoring.score(frame).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, round(math.log(1 / 2), 4))] * 2


def test_words_whose_hashes_agree_in_42_bits_stay_apart(make_docs):
    # Hashes 52edcdf6316f67bf and 978f59f6316f67bf, and 330a0aeafbf2f9ba and 8c5002eafbf2f9ba.
    rows = [(1, "w4228420 a"), (2, "w5863164 b"), (3, "a w1041731"), (4, "a w5343477 b"), (5, "b a")]
    got = sorted(map(tuple, lm_scoring.score(make_docs(rows)).collect()))
    for g, w in zip(got, want(rows), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-3)
