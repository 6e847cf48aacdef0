import gzip
import hashlib
import random
from pathlib import Path

from loomgraph.llm import common, warc
from loomgraph.llm.common import scratch

SCHEMA = "page_id long, url string, html string"


def want(rows):
    body = {i: (h or "").encode() for i, _, h in rows}
    out = set()
    for i, b in body.items():
        response = max(j for j in body if body[j] == b)
        again = len(b) >= 1000 and response != i
        out.add((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", response if again else None))
    return out


def rows_of(n):
    rng = random.Random(4)
    bodies = ["".join(rng.choices("abc é<>\r\n", k=rng.choice((10, 999, 1000, 3000)))) for _ in range(n // 3)]
    return [(i * 7, f"http://h/{i}\n?q= x", rng.choice(bodies)) for i in range(n)]


ROWS = [*rows_of(120), (5, None, None), (6, "", ""), (8, "u", "x" * 3_000_000), (9, "u", "x" * 3_000_000), (10**15, "u", "é" * 500), (11, "v", "é" * 500)]


def test_every_page_comes_back(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert {tuple(r) for r in warc.archived_pages(frame).collect()} == want(ROWS)
    assert warc.archived_pages(frame.limit(0)).collect() == []


def test_shards_and_rolled_files_are_the_same_bytes_each_time(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", (1000, 20_000))
    seen = []
    for parts in (1, 5):
        folder = scratch(spark, "test-warc")
        manifest = warc.write_archive(spark.createDataFrame(ROWS, SCHEMA).repartition(parts), folder, roll_bytes=3000)
        rows = manifest.orderBy("final").collect()
        files = {p.name: p.read_bytes() for p in Path(folder.removeprefix("file://")).glob("*.warc.gz")}
        assert {r.final: (r.bytes, r.sha256) for r in rows} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
        assert len({r.shard for r in rows}) > 3 and max(r.part for r in rows) > 0
        assert sum(r.records for r in rows) == len(ROWS)
        assert gzip.decompress(files[rows[0].final]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        seen.append(files)
    assert seen[0] == seen[1]
    got = warc.read_archive(spark, folder).collect()
    payloads = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    text = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(payloads[r.refers_to if r.record_type == "revisit" else r.page_id] == text[r.page_id] for r in got)


def test_repeated_rows_and_null_ids(spark):
    big, schema = "z" * 2000, SCHEMA + ", payload int, shard string"
    rows = [(4, "a", big, 1, ""), (4, "a", big, 1, ""), (3, "a", big, 1, ""), (None, "a", big, 1, ""), (None, None, None, None, None)]
    got = warc.archived_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [
        (0, "response", 0, 0), (0, "revisit", 4, 2000), (3, "revisit", 4, 2000), (4, "response", 0, 2000), (4, "response", 0, 2000),
    ]
    alone = warc.archived_pages(spark.createDataFrame([(None, "a", big), (None, "b", big)], SCHEMA)).collect()
    assert [(r.record_type, r.payload_bytes) for r in alone] == [("response", 2000)] * 2


def test_hot_payloads_and_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(warc, "SHARD_BYTES", (20_000, 40_000))
    rows = [(i, "u", "h" * 2000 if i % 2 else f"{i % 20:04d}" * 300) for i in range(80)]
    assert {tuple(r) for r in warc.archived_pages(spark.createDataFrame(rows, SCHEMA)).collect()} == want(rows)
    lost = [(None, f"u{i}", str(i) * 600) for i in range(60)]
    folder = scratch(spark, "test-warc")
    manifest = warc.write_archive(spark.createDataFrame(lost, SCHEMA), folder).collect()
    assert len({r.shard for r in manifest}) > 1 and sum(r.records for r in manifest) == 60
    assert sorted(r.url for r in warc.read_archive(spark, folder).collect()) == sorted(r[1] for r in lost)


def test_revisits_of_a_hot_payload_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, "u", "h" * 1500) for i in range(40)] + [(100 + i, "u", f"{i % 3}" * 1200) for i in range(9)] + [(200, "u", "short")]
    assert {tuple(r) for r in warc.archived_pages(spark.createDataFrame(rows, SCHEMA)).collect()} == want(rows)
