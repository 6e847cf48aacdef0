import hashlib
import zlib

import pytest

from loomgraph.llm import matroska as m


def want(text):
    body = (text or "").encode()
    payload = body + b"\xff" * ((-len(body)) % 576 if body else 576)
    return len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_round_trip_of_whole_texts(make_docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "é" * 288), (5, "x" * 577), (6, "long text " * 60_000), (7, "a"), (None, "a")]
    got = {r.doc_id: r for r in m.read_back(m.mux(make_docs(rows))).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want(text)
    assert got[3][1:] == got[7][1:] == got[None][1:]
    assert m.read_back(m.mux(make_docs(rows).limit(0))).collect() == []


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_each_lacing(lacing):
    frames = [bytes([i]) * n for i, n in enumerate((3, 700, 255, 1, 20_000, 254))] if lacing in (m.XIPH, m.EBML_LACING) else [b"ab"] * 4
    if lacing == m.NO_LACING:
        frames = frames[:1]
    data = m.element(m.SEGMENT, m.element(m.CLUSTER, m.number(m.TIMESTAMP, 5), m.block(frames, 300, -2, lacing)))
    packets = m.parse(data).packets
    assert [data[p.offset : p.offset + p.size] for p in packets] == frames
    assert {(p.track, p.timestamp_ns) for p in packets} == {(300, 3_000_000)}


def test_unknown_sizes_groups_and_cut_files():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.vint(1), b"\0\0\0abc"), m.number(m.REFERENCE, 1))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIMESTAMP, 1) + group
    data = m._HEADER + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    found = m.parse(data)
    assert [(p.cluster, p.keyframe, data[p.offset : p.offset + p.size]) for p in found.packets] == [(0, False, b"abc"), (1, False, b"abc")]
    whole = m.mux_bytes(b"q" * 576 * 20)
    n = len(m.parse(whole).packets)
    assert n == 20
    for cut in range(0, len(whole), 97):
        assert len(m.parse(whole[:cut]).packets) <= n
    for junk in (b"", b"\0\0", b"junk" * 9):
        assert m.parse(junk).packets == []


def test_packet_table(make_docs, spark):
    media = m.mux(make_docs([(1, "x" * 576 * 300), (2, None)]))
    rows = m.packet_table(media).orderBy("doc_id", "packet").collect()
    assert [r.packet for r in rows if r.doc_id == 1] == list(range(300))
    assert all(r.timestamp_ns == r.packet * 72_000_000 and r.size == 576 and r.keyframe for r in rows)
    assert {r.cluster for r in rows} == {0, 1}
    assert m.packet_table(spark.createDataFrame([(1, None), (2, bytearray(b"zz"))], "doc_id long, media binary")).collect() == []


def test_media_columns_and_clashing_names(spark):
    names = ["media", "n_bytes", "body", "feature", "a.b"]
    rows = [(1, "x" * 700), (1, "x" * 700), (None, None), (2, "é" * 40_000)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    media = m.mux(docs)
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    got = m.read_back(media).collect()
    assert len(got) == 4
    for r in got:
        own = stored[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(own), hashlib.sha256(own).hexdigest())
        payload = want(dict(rows)[r.doc_id])[1]
        fields = dict(x.split("=") for x in r.feature.split(";"))
        samples = (dict(rows)[r.doc_id] or "").encode()
        samples += b"\xff" * (payload - len(samples))
        assert int(fields["packets"]) == payload // 576 and int(fields["ms"]) == payload // 576 * 72
        assert (int(fields["min"]), int(fields["max"])) == (min(samples), max(samples)) and float(fields["mean"]) == round(sum(samples) / payload, 4)
        assert int(fields["clusters"]) == int(fields["cued"]) > 0
