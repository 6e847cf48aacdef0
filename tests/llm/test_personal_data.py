import hashlib
import itertools
import math
import random
import re
import time

import pytest

from loomgraph.llm import personal_data as pii
from loomgraph.llm.personal_data import Span

# The contract's patterns, as they stand.
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, rank == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d or "0"), 10 <= len(d) <= 15)[rank]
            if ok:
                out.append(Span(m.start(), rank, m.end()))
    return sorted(out)


CASES = [
    "", "x", "a@b.c", "a@b.c_d@e.f", "a@b@c.d", "@b.c", "a..b@-.-", "ü@b.c x@ü.de me@host", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 001.02.3.4",
    "0000000000255.1.1.1", "4539 1488 0343 6467", "4539-1488-0343-6467 4539148803436467", "4539148803436468", "45391488034364671234567", "+1 (743) 555-3824",
    "+12", "+1 2", "++49 30 1234567-89)", "+1 4539148803436467", "+(1) 234 567 8901", "٣.٣.٣.٣ ４５３９", "10.0.0.1@x.y", "a@1.2.3.4",
]


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(3)
    texts = CASES + ["".join(draw.choice("0123456789.@+-() abZ%_é") for _ in range(draw.randrange(60))) for _ in range(20_000)]
    for text in texts:
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "1." * 500_000, "+1(" * 300_000, "1 " * 500_000])
def test_time_grows_with_the_text(text):
    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 10


def segmentations(own):
    n = len(own.begins)
    for take in range(n + 1):
        for chosen in itertools.combinations(range(n), take):
            spans = sorted((own.begins[i], own.ends[i]) for i in chosen)
            if all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])):
                yield chosen


def test_dynamic_programs_equal_enumeration():
    draw = random.Random(5)
    for _ in range(200):
        spans = sorted({Span(a, draw.randrange(4), a + 1 + draw.randrange(4)) for a in (draw.randrange(9) for _ in range(7))})
        own, scores = pii.passage(spans, [], set()), [draw.uniform(-2, 2) for _ in spans]
        weight = {c: math.exp(sum(scores[i] for i in c)) for c in segmentations(own)}
        total, chance = pii.marginals(own, scores)
        assert total == pytest.approx(math.log(sum(weight.values())))
        for i, p in enumerate(chance):
            assert p == pytest.approx(sum(w for c, w in weight.items() if i in c) / sum(weight.values()))
        best = pii.best_segmentation(own, scores)
        assert sum(scores[i] for i in best) == pytest.approx(max(sum(scores[i] for i in c) for c in weight))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def corpus():
    draw, rows = random.Random(7), []
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    for i in range(300):
        body = str(4 * 10**14 + draw.randrange(10**14))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        data = [f"user.{i}@mail{i % 9}.example.com", f"{i % 200 + 1}.20.{i % 250}.7", card, f"+1 ({200 + i % 700}) 555-{1000 + i}"][i % 4]
        rows.append((i, " ".join(draw.choices(words, k=12) + [data] + draw.choices(words, k=12))))
    return rows


def test_field_finds_other_forms_and_leaves_clean_texts_alone(spark, corpus):
    card = next(c for c in ("4539148803436467",))
    hidden = [
        (1000, "alpha beta user.7 (at) mail3.example.com gamma", "email"), (1001, f"gamma {'.'.join(card[i:i+4] for i in range(0, 16, 4))} beta", "card"),
        (1002, "eta 10[.]20[.]30[.]40 beta", "ip"), (1003, "delta (743) 555-3824 kappa", "phone"),
    ]
    clean = [
        "No data here.", "On 2024-01-05 12:30:55 we met 14 of 20.", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "Order 1234567890 of 12.03.2021",
        "Version 2.0.1, 1,234,567.89 or 3.14159", "4539148803436468 is no card", "300.400.500.600", "See (1999) 12 and pages 100-200, 300-400.",
    ]
    rows = corpus + [(i, t) for i, t, _ in hidden] + [(2000 + i, t) for i, t in enumerate(clean)]
    found = {r.doc_id: r for r in pii.personal_data(docs_of(spark, rows)).collect()}
    for i, _, kind in hidden:
        assert found[i].spans.startswith(f"{kind}:") and found[i].n_added == 1, (i, found[i])
    for i, text in enumerate(clean):
        assert found[2000 + i].spans == "", text
    assert all(found[i].n_added == 0 and found[i].spans for i, _ in corpus)


def test_rows_and_columns(spark, corpus):
    rows = corpus[:40] + [(0, corpus[0][1]), (None, corpus[1][1]), (501, None), (502, ""), (503, "x" * 100_000 + " a@b.c")]
    docs = docs_of(spark, rows)
    for name in ("body", "spans", "n_ip", "mark", "kind"):
        docs = docs.withColumn(name, docs.doc_id)
    got = pii.personal_data(docs).collect()
    expect = []
    for doc_id, text in rows:
        base = brute(text or "")
        sha = hashlib.sha256(",".join(f"{pii.KINDS[s.rank]}:{s.start}:{s.end}" for s in base).encode()).hexdigest()
        expect.append((doc_id, *[sum(s.rank == k for s in base) for k in range(4)], sha))
    key = lambda r: str(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(expect, key=key)


def test_without_rows_or_matches(spark):
    empty = docs_of(spark, [(1, "a")]).limit(0)
    assert pii.personal_data(empty).collect() == []
    got = pii.personal_data(docs_of(spark, [(1, "call 743.555.3824"), (2, None)])).collect()
    assert [(r.doc_id, r.spans, r.n_added) for r in sorted(got)] == [(1, "", 0), (2, "", 0)]


def test_weights_do_not_depend_on_layout(spark, corpus):
    one = pii.trained(docs_of(spark, corpus).coalesce(1)).weights
    many = pii.trained(docs_of(spark, corpus[::-1]).repartition(5)).weights
    assert one == many
