import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, exact_dedup


def want(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    out = set()
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        out.add((i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest()))
    return out


ROWS = [(9, "a  b"), (3, "a\t\nb"), (5, "a b "), (4, "A b"), (1, None), (2, ""), (7, " "), (8, "\x0b\x0c"), (10, "a\xa0b"), (11, "long " * 50_000), (12, "long  " * 50_000), (13, "é\x1cz")]


def test_groups_by_normalised_text(make_docs):
    got = exact_dedup.exact_duplicates(make_docs(ROWS))
    assert {tuple(r) for r in got.collect()} == want(ROWS)


def test_full_bytes_decide_where_digests_collide(make_docs):
    got = exact_dedup.exact_duplicates(make_docs(ROWS), digest=lambda body: F.octet_length(body) % 2)
    assert {tuple(r) for r in got.collect()} == want(ROWS)


def test_state_goes_on_over_many_batches(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILES_PER_BATCH", 1)
    rows = [(i, f"text {i % 5}") for i in range(40)]
    got = exact_dedup.exact_duplicates(make_docs(rows).repartition(3))
    assert {tuple(r) for r in got.collect()} == want(rows)


def test_empty_table_repeated_rows_and_null_ids(spark, make_docs):
    assert exact_dedup.exact_duplicates(make_docs([(1, "a")]).limit(0)).collect() == []
    frame = spark.createDataFrame([(7, "a", 1), (7, "a", 2), (None, "a", 3), (None, "b", 4)], "doc_id long, text string, digest int")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame).collect())
    assert got == [(0, 0, 1, True), (0, 7, 3, False), (7, 7, 3, False), (7, 7, 3, True)]


def test_new_arrivals_meet_earlier_ones(make_docs, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(10, 40)]
    later = [(3, "text  1"), (50, "text 2"), (51, "own"), (52, "own ")]
    store = f"file://{tmp_path}/store"
    assert {tuple(r) for r in exact_dedup.exact_duplicates(make_docs(rows), store=store).collect()} == want(rows)
    assert {tuple(r) for r in exact_dedup.exact_duplicates(make_docs(later), store=store).collect()} == want(rows + later)
    assert {tuple(r) for r in exact_dedup.exact_duplicates(make_docs([(1, "a")]).limit(0), store=store).collect()} == want(rows + later)


def test_hot_digests(make_docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "hot" if i % 2 else f"text {i % 20}") for i in range(60)]
    assert {tuple(r) for r in exact_dedup.exact_duplicates(make_docs(rows)).collect()} == want(rows)
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert {tuple(r) for r in exact_dedup.exact_duplicates(make_docs(rows)).collect()} == want(rows)


def test_first_copies_keep_columns_and_do_not_depend_on_layout(spark):
    names = ["doc_id", "text", "_text_sha256", "row", "run", "row_id", "digest", "first", "n", "body", "tie", "a.b"]
    rows = [(i % 3 if i % 4 else None, "a  b" if i % 2 else "a b", *[f"{c}{i}" for c in names[2:]]) for i in range(24)]
    schema = ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names)
    found = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        kept = exact_dedup.first_copies(docs)
        assert kept.columns == names and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        [row] = kept.collect()
        assert row.doc_id == 0 and tuple(row) in set(rows)
        found.add(tuple(row))
    assert len(found) == 1


def test_a_failed_run_is_repeated_under_its_name(make_docs, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    rows = [(i, f"text {i % 7}") for i in range(10, 40)]
    exact_dedup.add(make_docs(rows), store, run="first")
    later = make_docs([(3, "text  1"), (50, "text 2"), (51, "own")])

    def broken(*_):
        raise RuntimeError("killed")

    # Killed before the rows arrive, then between their arrival and the stream.
    for part in ("move", "_stream"):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(exact_dedup, part, broken)
            exact_dedup.add(later, store, run="second")
    everything = want(rows + [(3, "text  1"), (50, "text 2"), (51, "own")])
    for _ in range(2):
        got = exact_dedup.exact_duplicates(later, store=store, run="second")
        assert {tuple(r) for r in got.collect()} == everything and got.count() == 33
    with pytest.raises(ValueError):
        exact_dedup.add(later, store, run="../second")


def test_bytes_are_read_of_hits_only(make_docs, tmp_path):
    store = f"file://{tmp_path}/store"
    docs = make_docs([(i, f"text {i % 50}") for i in range(80)] + [(100, None), (101, "")])
    exact_dedup.add(docs, store)
    found = exact_dedup.groups(docs.sparkSession, store)
    got = exact_dedup.hits(exact_dedup.arrivals_of(docs.sparkSession, store), found)
    want_texts = sorted([f"text {i % 50}" for i in range(80) if i % 50 < 30] + ["", ""])
    assert sorted(r.text or "" for r in got.collect()) == want_texts
