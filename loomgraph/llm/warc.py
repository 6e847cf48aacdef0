"""WARC archives from a table of pages, and back.

Records are dealt to shards by ranges of page_id (and, within one, of a hash of url and payload) that
hold equal bytes, sorted, and written one gzip member each; a file is closed when its compressed size passes ``roll_bytes``. Tasks write under
temporary names and return manifest rows; only files of the manifest get their final names, so lost
or repeated tasks leave no trace in the archive. The same pages give the same bytes: shards, order,
dates, record ids and gzip headers depend on the rows alone.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.blocks import unpack
from loomgraph.llm.common import bodies, join_counted, saved, scratch, shuffle_partitions

#: Equal payloads below this many bytes are stored again rather than revisited.
LEAST_REVISIT = 1000
ROLL_BYTES = 1 << 30
SHARD_BYTES = (16 << 20, 2 << 30)
DATE = "2000-01-01T00:00:00Z"
#: Bytes that a record counts besides its payload when shards are cut.
OVERHEAD = 600
# Fixed value: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, temporary string, final string, records long, bytes long, sha256 string, first_page long, last_page long"
NAMES = [x.split()[0] for x in MANIFEST.split(", ")]


# ---- records


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record as one gzip member without a time stamp."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool) -> bytes:
    """``response`` is the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest32(payload)),
        ("WARC-Block-Digest", digest32(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response)), ("X-Refers-To-Page-ID", str(response))]
    return member(head, block)


def read_members(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzipped WARC file."""
    raw = b""
    while True:
        undo, out = zlib.decompressobj(31), []
        raw = raw or stream.read(chunk)
        if not raw:
            return
        while not undo.eof:
            if not raw and not (raw := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            out.append(undo.decompress(raw))
            raw = b""
        raw = undo.unused_data
        text, _, rest = b"".join(out).partition(b"\r\n\r\n")
        version, *lines = text.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(head["content-length"])
        if len(rest) != size + 4:
            raise ValueError("a block has another length than its header says")
        yield head, rest[:size]


# ---- writing


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and what sorts equal page_ids."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumn("mark", F.xxhash64(F.col("url").cast("binary"), "payload"))


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, mark, response (page_id of the group's response, else null), revisit.

    Groups are rows of equal payload of ``LEAST_REVISIT`` bytes or more; the row with the largest
    page_id is the response. Rows repeated with that page_id are responses too; a null page_id never
    names the response of a group that has another. A null html is an empty payload, hence a response.
    Short payloads aren't joined to anything; payloads of very many pages are joined where they lie.
    """
    rows = _pages(pages)
    own = ("page_id", "url", "payload", "mark")
    short = rows.filter(F.octet_length("payload") < LEAST_REVISIT)
    long = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).withColumn("same", F.sha2("payload", 256))
    groups = long.groupBy("same").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    groups = saved(groups, "warc-groups")
    joined = join_counted(long, groups, ["same"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull(), F.lit(False))
    none = F.lit(None).cast("long")
    return joined.select(*own, F.when(revisit, F.col("response")).alias("response"), revisit.alias("revisit")).unionByName(
        short.select(*own, none.alias("response"), F.lit(False).alias("revisit"))
    )


def shard_cuts(pages: DataFrame) -> list[tuple[bool, int, int]]:
    """First key (has a page_id, page_id, mark) of each shard but the first; shards hold about equal bytes.

    Bytes up to a page are summed over a range-sorted narrow table, so the cuts depend on the rows
    and not on Spark's own ranges. Rows equal in page_id, url and payload stay together. What comes to
    the driver is a row per partition and per shard.
    """
    weight = (F.octet_length("payload") + OVERHEAD).cast("long")
    key = F.struct(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("id"), "mark").alias("key")
    narrow = _pages(pages).select(key, weight.alias("w"))
    n = shuffle_partitions(pages.sparkSession)
    ranged = saved(narrow.repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()), "warc-ranges")
    sums = {r["range"]: r["w"] for r in ranged.groupBy("range").agg(F.sum("w").alias("w")).collect()}
    total = sum(sums.values())
    target = min(max(total // 1000, SHARD_BYTES[0]), SHARD_BYTES[1])
    if total <= target:
        return []
    before, at = {}, 0
    for k in sorted(sums):
        before[k], at = at, at + sums[k]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("range"))
    # Equal keys are peers of the window: they come to the same sum and to one shard.
    upto = F.sum("w").over(Window.partitionBy("range").orderBy("key"))
    shard = F.floor((start + upto - 1) / target)
    cuts = ranged.select("key", shard.alias("shard")).groupBy("shard").agg(F.min("key").alias("first"))
    return sorted(tuple(r["first"]) for r in cuts.collect())[1:]


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files in ``folder``, a URI that all machines see.

    Returns the manifest, which is also kept in ``folder/manifest``: a row per file. An empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    cuts = shard_cuts(pages)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("page_id").to_pylist(), batch.column("mark").to_pylist())
            shard = pa.array([bisect_right(cuts, (i is not None, i or 0, mark)) for i, mark in keys], pa.int32())
            codec = pa.Codec("zstd", compression_level=6)
            packed = pa.array([len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True) for b in bodies(batch.column("payload"))], pa.binary())
            columns = [packed if name == "payload" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([shard, *columns], ["shard", *batch.schema.names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(posixpath.join(root, "_temporary"), recursive=True)
        out = None
        for batch in batches:
            for at in range(batch.num_rows):
                shard, page_id, url, payload, response, revisit = (batch.column(c)[at].as_py() for c in ("shard", "page_id", "url", "payload", "response", "revisit"))
                if out and (out.shard != shard or out.bytes >= roll_bytes):
                    yield out.close()
                    out = _File(store, root, shard, out.part + 1 if out.shard == shard else 0)
                out = out or _File(store, root, shard, 0)
                out.add(page_id, page_member(page_id, url, unpack(payload, "u1").tobytes(), response, revisit))
        if out:
            yield out.close()

    schema = "shard int, page_id long, url string, payload binary, mark long, response long, revisit boolean"
    numbered = decide(pages).mapInArrow(number, schema)
    dealt = numbered.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "mark", "url", "payload")
    manifest = saved(dealt.mapInArrow(write, MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = (posixpath.join(root, row[k]) for k in ("temporary", "final"))
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, target)
                elif store.get_file_info(target).size != row["bytes"]:
                    raise FileNotFoundError(target)
            yield batch

    manifest.mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _File:
    """A file that grows under a temporary name."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, part: int):
        self.shard, self.part, self.bytes, self.records = shard, part, 0, 0
        self.first = self.last = None
        self.final = f"shard-{shard:06d}-{part:04d}.warc.gz"
        self.temporary = f"_temporary/{self.final}.{uuid.uuid4().hex}"
        self.digest = hashlib.sha256()
        self.stream = store.open_output_stream(posixpath.join(root, self.temporary), compression=None)
        info = b"software: loomgraph\r\nformat: WARC File Format 1.1\r\n"
        ident = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, self.final)}>"
        self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Filename", self.final), ("Content-Type", "application/warc-fields")], info))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        self._put(data)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        row = (self.shard, self.part, self.temporary, self.final, self.records, self.bytes, self.digest.hexdigest(), self.first, self.last)
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], NAMES)


# ---- reading


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page record of a committed archive: page_id, url, record_type, refers_to, digest, payload.

    ``digest`` (hex) is taken from the payload of a response and from the header of a revisit, whose
    payload is null. A file that isn't what the manifest says raises an error.
    """
    schema = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                found, size = [], 0
                with store.open_input_stream(posixpath.join(root, row["final"]), compression=None) as stream:
                    for head, block in read_members(stream):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        found.append(_page(head, block))
                        size += len(block)
                        if size > 4_000_000:
                            yield to_batch(found)
                            found, size = [], 0
                yield to_batch(found)

    def to_batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = manifest.repartition(shuffle_partitions(spark), "final")
    return files.mapInArrow(read, schema)


def _page(head: dict[str, str], block: bytes) -> tuple:
    _, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    page = int(head["x-page-id"]) if "x-page-id" in head else None
    if head["warc-type"] == "revisit":
        return page, head["warc-target-uri"], "revisit", int(head["x-refers-to-page-id"]), stated, None
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"page {page}: the payload isn't what its digest says")
    return page, head["warc-target-uri"], "response", None, digest, payload


def archived_pages(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write an archive below the shared folder, read it back, and say what was found for each page.

    A revisit's bytes and digest are those of the response it refers to, as read back. A null html is
    stored as an empty payload; null page_ids come back as null, repeated rows as often as they came.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archive(pages, folder, roll_bytes)
    found = read_archive(spark, folder)
    found = saved(found.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "warc-read")
    responses = found.filter("record_type = 'response'")
    kept = responses.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits, key = found.filter("record_type = 'revisit'").drop("payload_bytes"), ["refers_to", "digest"]
    referred = revisits.groupBy(*key).agg(F.count("*").alias("n")).join(kept, key)
    out = responses.unionByName(join_counted(revisits, saved(referred, "warc-referred"), key).drop("n"))
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
