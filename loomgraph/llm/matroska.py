"""Matroska as a column: EBML elements, clusters, lacing and cues to packet tables and back.

``mux`` stores bytes as 8-bit PCM in one audio track; ``packet_table`` parses any Matroska column
into one row per frame with track, timestamp and byte range; ``read_back`` gives the payload's
digests and features from the frames that the parser finds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bodies, with_bytes

# Element ids of EBML and Matroska, the int16 range of block timestamps.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, RATE = 576, 8000
FRAME_NS = FRAME * 1_000_000_000 // RATE
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 32


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    cluster: int
    offset: int
    size: int


class Parsed(NamedTuple):
    packets: list[Packet]
    clusters: list[int]  # offsets
    cues: list[tuple[int, int, int]]  # timestamp in ns, track, offset of the cluster
    codecs: dict[int, str]


# ---- writing


def vint(value: int, width: int = 0) -> bytes:
    """A size of the least width (or ``width``) whose bits are not all ones."""
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(tag: int, value: int) -> bytes:
    return element(tag, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frame count and sizes that stand before laced frames."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == EBML_LACING:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head


def block(frames: list[bytes], track: int, relative: int, kind: int) -> bytes:
    kind = kind if len(frames) > 1 else NO_LACING
    head = vint(track) + struct.pack(">hB", relative, 0x80 | kind << 1)
    return element(SIMPLE_BLOCK, head, lace(frames, kind) if kind else b"", *frames)


_HEADER = element(
    EBML, number(EBML_VERSION, 1), number(EBML_READ_VERSION, 1), number(MAX_ID, 4), number(MAX_SIZE, 8),
    element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY, number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), number(FLAG_LACING, 1),
        number(DEFAULT_DURATION, FRAME_NS), element(CODEC_ID, b"A_PCM/INT/LIT"),
        element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)), number(CHANNELS, 1), number(BIT_DEPTH, 8)),
    ),
)


def mux_bytes(payload: bytes, lacing: int = FIXED) -> bytes:
    """A Matroska file of ``payload`` (a positive multiple of 576 bytes) as 8-bit samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME_NS // 1_000_000
    info = element(
        INFO, number(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(frames) * ms)),
        element(MUXING_APP, b"loomgraph"), element(WRITING_APP, b"loomgraph"),
    )
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), step):
        blocks = [
            block(frames[i : min(i + FRAMES_PER_BLOCK, first + step)], 1, (i - first) * ms, lacing)
            for i in range(first, min(first + step, len(frames)), FRAMES_PER_BLOCK)
        ]
        cues.append(element(CUE_POINT, number(CUE_TIME, first * ms), element(CUE_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, number(TIMESTAMP, first * ms), *blocks))
        at += len(parts[-1])
    return _HEADER + element(SEGMENT, *parts, element(CUES, *cues))


# ---- parsing


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and end of a variable-length integer; -1 for the reserved unknown size."""
    first = data[at]
    if not first:
        raise ValueError("no marker in the first byte")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError("cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value -= 1 << 7 * n
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, until: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the children within ``at``..``end``; a broken or cut element ends them.

    An element of unknown size reaches to the next element of the top level, or to the end.
    """
    while at < end:
        try:
            tag, start = read_vint(data, at, True)
            if tag in until:
                return
            size, start = read_vint(data, start)
        except (ValueError, IndexError):
            return
        if size < 0:
            stop = end if tag == SEGMENT else max((e for _, _, e in elements(data, start, end, TOP_LEVEL)), default=start)
        else:
            stop = start + size
        if stop > end and tag not in (SEGMENT, CLUSTER):
            return
        yield tag, start, min(stop, end)
        at = stop


def frame_ranges(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative timestamp, key flag and (offset, size) of the frames of a block."""
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, relative, bool(flags & 0x80), [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        sizes = [(end - at) // n] * (n - 1)
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            width = 9 - data[at].bit_length()
            value, at = read_vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    starts = [at]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)
    return track, relative, bool(flags & 0x80), list(zip(starts, sizes))


def parse(data: bytes) -> Parsed:
    """All frames, clusters and cues of a Matroska file; what is broken or cut off is left out."""
    out = Parsed([], [], [], {})
    value = lambda a, b: int.from_bytes(data[a:b], "big")
    for tag, start, end in elements(data, 0, len(data)):
        if tag == SEGMENT:
            scale, durations = 1_000_000, {}
            for top, a, b in elements(data, start, end):
                if top == INFO:
                    scale = next((value(x, y) for t, x, y in elements(data, a, b) if t == TIMESTAMP_SCALE), scale)
                elif top == TRACKS:
                    for t, x, y in elements(data, a, b):
                        if t == TRACK_ENTRY:
                            own = {k: (p, q) for k, p, q in elements(data, x, y)}
                            if TRACK_NUMBER in own:
                                n = value(*own[TRACK_NUMBER])
                                durations[n] = value(*own.get(DEFAULT_DURATION, (0, 0)))
                                out.codecs[n] = data[slice(*own.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")
                elif top == CLUSTER:
                    _cluster(data, a, b, scale, durations, out)
                elif top == CUES:
                    for t, x, y in elements(data, a, b):
                        own = {k: (p, q) for k, p, q in elements(data, x, y)} if t == CUE_POINT else {}
                        if CUE_TIME in own and CUE_POSITIONS in own:
                            place = {k: value(p, q) for k, p, q in elements(data, *own[CUE_POSITIONS])}
                            out.cues.append((value(*own[CUE_TIME]) * scale, place.get(CUE_TRACK, 0), start + place.get(CUE_CLUSTER, 0)))
    return out


def _cluster(data: bytes, a: int, b: int, scale: int, durations: dict[int, int], out: Parsed) -> None:
    n, base = len(out.clusters), 0
    out.clusters.append(a)
    for tag, start, end in elements(data, a, b, TOP_LEVEL):
        if tag == TIMESTAMP:
            base = int.from_bytes(data[start:end], "big")
        found = []
        if tag == SIMPLE_BLOCK:
            found = [(start, end, None)]
        elif tag == BLOCK_GROUP:
            inside = list(elements(data, start, end))
            key = all(t != REFERENCE for t, _, _ in inside)
            found = [(x, y, key) for t, x, y in inside if t == BLOCK]
        for x, y, key in found:
            try:
                track, relative, flag, frames = frame_ranges(data, x, y)
            except (ValueError, IndexError, struct.error):
                continue
            flag = flag if key is None else key
            for i, (offset, size) in enumerate(frames):
                stamp = (base + relative) * scale + i * durations.get(track, 0)
                out.packets.append(Packet(track, stamp, flag, n, offset, size))


# ---- DataFrames


def padded(body: bytes) -> bytes:
    return body + b"\xff" * (-len(body) % FRAME or FRAME * (not body))


def mux(docs: DataFrame, lacing: int = FIXED) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: each whole text, filled up to frames, as a Matroska file.

    A null or empty text gives one frame of filling. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                media = [mux_bytes(padded(body), lacing) for body in bodies(batch.column(1))]
                sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32, batch.num_rows + 1, batch.column(1).offset * 4)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    source = with_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def packet_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per frame of the ``media`` column: key, packet, track, timestamp_ns, keyframe, cluster, offset, size.

    ``offset`` and ``size`` are the frame's bytes within ``media``. Null or broken media have no rows.
    """
    schema = f"{key} long, packet int, track int, timestamp_ns long, keyframe boolean, cluster int, offset long, size long"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 100):
                rows = [
                    (k, i, *p)
                    for k, body in zip(batch.column(0).to_pylist(), bodies(batch.column(1)))
                    for i, p in enumerate(parse(body).packets)
                ]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    source = media.select(F.col(key).cast("long").alias(key), F.coalesce("media", F.lit(b"")).alias("media"))
    return source.mapInArrow(run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of the payload that lies in the frames of ``media`` (columns of ``mux``).

    ``feature`` names packets, clusters, cues that point at a cluster, milliseconds, and mean, least
    and largest sample. Rows stay as they are, repeated or with a null doc_id; a null or unreadable
    medium has no packets, so its payload is empty. Other columns are not read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(body: bytes) -> tuple:
        found = parse(body)
        payload = b"".join([body[p.offset : p.offset + p.size] for p in found.packets])
        heads = {c for _, _, c in found.cues}
        hits = sum(any(h < c <= h + 12 for h in heads) for c in found.clusters)
        samples = np.frombuffer(payload, np.uint8)
        level = f"mean={samples.mean():.4f};min={samples.min()};max={samples.max()}" if len(samples) else "mean=;min=;max="
        ms = (found.packets[-1].timestamp_ns + FRAME_NS) // 1_000_000 if found.packets else 0
        feature = f"packets={len(found.packets)};clusters={len(found.clusters)};cued={hits};ms={ms};{level}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(body), hashlib.sha256(body).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(one, bodies(batch.column("media"))))) or [()] * 6
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types[2:]))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
