"""Alignment of two tokenizers' tokens by a sweep over the ends of both.

A task encodes its texts with both tokenizers and emits the ends of tokens as events, in runs: a run is
the ids of one side over one stretch of a document, from which the ends follow by the lengths of the
ids' bytes. Runs are dealt by document and sorted by offset; a machine that holds one stretch and a
document's sums goes along them. Where both sides end a token a group ends, and every token of a group
on one side is linked with every one on the other.

Stretches begin at spaces after a visible character. Neither tokenizer joins anything across such a
space, so a distinct word is encoded once per task.

How many documents hold a pair is counted like n-grams in ``lm_scoring``: documents' distinct pairs lie
in blocks, and blocks ask buckets of pairs for the counts over all documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import NO_ID, Block, buckets_for, counted, distinct_keys, lists, make_blocks, read_blocks, totals_of
from loomgraph.llm.bpe import byte_characters
from loomgraph.llm.common import bodies

#: Words of one stretch, and distinct words (and their characters) that a task keeps.
STRETCH, CACHE_WORDS, CACHE_CHARS = 100_000, 250_000, 16 << 20
#: Words that go to a library at once, which holds much more of each than its ids.
ENCODED = 5_000
#: Tokens that the machine takes at once.
AT_ONCE = 1_000_000
# What no stretch begins after. White space and what resembles it, in one or the other tokenizer.
_SPACES = [(0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_UNSAFE = "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in _SPACES)
_BEGINS = re.compile(f"(?<=[^{_UNSAFE}])(?= )")
_JOINS = re.compile(f"[{_UNSAFE}] ")
#: Signs before which a word is cut if it ends in a letter and no token of either side has a letter before the sign.
SIGNS = ",.;:!?"
# Code points that are letters to both tokenizers.
_LETTERS = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
#: An odd multiplier of 64 bits: pairs are dealt by their product with it, which keeps them apart.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _words(signs: str) -> re.Pattern:
    """A space and what follows up to a sign after a letter, or up to the next space; a sign and what follows."""
    if not signs:
        return re.compile(" [^ ]*")
    own = re.escape(signs)
    return re.compile(f" [^ {own}]*+(?<=[{_LETTERS}])(?=[{own}])|[ {own}][^ ]*")


def stretches(text: str, signs: str = "") -> list[str]:
    """A space and ``text``, cut before spaces that follow a visible character, and before ``signs`` that follow a letter."""
    text = f" {text}"
    if text.startswith("  ") or _JOINS.search(text, 1):
        return _BEGINS.split(text)
    return _words(signs).findall(text)


def _places(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (``size`` of them) for each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


class Side:
    """One tokenizer: ids of words, the bytes of each id, and the signs that it joins to letters."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            alone = model.piece_to_id("▁")
            # The library puts a space before and gives nothing for an empty text.
            before = len(model.encode("a"))

            def encode(words: list[str]) -> list[list[int]]:
                found = model.encode([w[1:] if w[0] == " " else f"a{w}" for w in words], num_threads=1)
                return [[alone] if w == " " else ids if w[0] == " " else ids[before:] for w, ids in zip(words, found)]

            self.encode = encode
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        else:
            from tokenizers import Tokenizer

            # A task has one core; the library would start a thread for each of the machine's.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.encode = lambda words: [e.ids for e in model.encode_batch_fast(words, add_special_tokens=False)]
            back = {c: b for b, c in enumerate(byte_characters())}
            spec = json.load(open(path, encoding="utf-8"))
            names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: "" for t in spec["added_tokens"]}
            self.bytes = [bytes(back[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        joined = re.compile(f"[{_LETTERS}]([{re.escape(SIGNS)}])")
        self.joins = {c for b in self.bytes for c in joined.findall(b.decode("utf-8", "replace"))}


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


class Known:
    """Ids of distinct words by both tokenizers, and whether their bytes are the words' own."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self.signs = "".join(c for c in SIGNS if not any(c in s.joins for s in sides))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.right = np.zeros(0, bool)
        self.start = [np.zeros(0, np.int64)] * 2
        self.size = [np.zeros(0, np.int64)] * 2
        self.flat = [np.zeros(0, np.uint32)] * 2

    def keep(self, words: set[str]) -> None:
        """Forget all but ``words``, which are the frequent ones among what is known."""
        held = list(words & self.index.keys())
        at = np.fromiter(map(self.index.__getitem__, held), np.int64, len(held))
        found = [self.ids(k, at) for k in (0, 1)]
        right, size = self.right[at], [self.size[k][at] for k in (0, 1)]
        self.clear()
        self.index, self.chars, self.right, self.size = dict(zip(held, range(len(held)))), sum(map(len, held)), right, size
        self.start, self.flat = [ends - n for (_, ends), n in zip(found, size)], [ids for ids, _ in found]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.keep(words)
            new = [w for w in words if w not in self.index]
        self.chars += sum(map(len, new))
        right, sizes, flat = [], [[], []], [[], []]
        for low in range(0, len(new), ENCODED):
            part = new[low : low + ENCODED]
            ok = np.ones(len(part), bool)
            for k, own in enumerate(self.sides):
                found = own.encode(part)
                name = own.bytes.__getitem__
                ok &= np.fromiter((b"".join(map(name, ids)) == w.encode() for w, ids in zip(part, found)), bool, len(part))
                sizes[k].append(np.fromiter(map(len, found), np.int64, len(part)))
                flat[k].append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[k][-1].sum())))
            right.append(ok)
        if new:
            self.right = np.concatenate([self.right, *right])
            for k in (0, 1):
                size = np.concatenate(sizes[k])
                self.start[k] = np.concatenate([self.start[k], len(self.flat[k]) + np.cumsum(size) - size])
                self.size[k] = np.concatenate([self.size[k], size])
                self.flat[k] = np.concatenate([self.flat[k], *flat[k]])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))

    def ids(self, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and where those of each word end."""
        size = self.size[k][words]
        return self.flat[k][_places(self.start[k][words], size)], np.cumsum(size)


@lru_cache(maxsize=1)
def known_words(a: str, b: str) -> Known:
    """Kept by a Python worker from task to task."""
    return Known((side(a), side(b)))


def _pack(ids: np.ndarray) -> bytes:
    """Ids by planes of their bytes."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: 2 if ids.max(initial=0) < 1 << 16 else 4])
    return bytes([len(planes)]) + len(ids).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    planes, n = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.decompress(data[9:], planes * n, codec="zstd", asbytes=True), np.uint8).reshape(planes, n) if n else np.zeros((4, 0), np.uint8)
    whole = np.zeros((n, 4), np.uint8)
    whole[:, : len(raw)] = raw.T
    return whole.reshape(-1).view("<u4")


_EVENTS = "row long, doc_id long, at long, side int, ids binary"


def events(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Runs of ends of both sides' tokens: row, doc_id, at (bytes before the stretch), side, ids.

    A text that has no tokens, or whose tokens' bytes aren't its own, gives one run of side 0 without ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(a, b)
        for batch in batches:
            held, size = [], 0
            for row, doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies(batch.column(2))):
                held.append((row, doc_id, stretches(body.decode(), known.signs) if body else []))
                size += len(body)
                if size > 2_000_000:
                    yield of(known, held)
                    held, size = [], 0
            if held:
                yield of(known, held)

    def of(known: Known, held: list[tuple]) -> pa.RecordBatch:
        known.learn({w for _, _, words in held for w in words})
        counts = [len(words) for _, _, words in held]
        index = np.fromiter(map(known.index.__getitem__, chain.from_iterable(words for _, _, words in held)), np.int64, sum(counts))
        wrong = np.r_[0, np.cumsum(~known.right[index])]
        found = [known.ids(k, index) for k in (0, 1)]
        ends = [np.r_[0, e] for _, e in found]
        bytes_a = np.r_[0, np.cumsum(known.sides[0].lengths[found[0][0]])]
        out, low = [], 0
        for (row, doc_id, _), n in zip(held, counts):
            high = low + n
            if not n or wrong[high] > wrong[low]:
                out.append((row, doc_id, 0, 0, _pack(np.zeros(0, np.uint32))))
                low = high
                continue
            first = bytes_a[ends[0][low]]
            for a in range(low, high, STRETCH):
                b = min(a + STRETCH, high)
                at = int(bytes_a[ends[0][a]] - first)
                out += [(row, doc_id, at, k, _pack(found[k][0][ends[k][a] : ends[k][b]])) for k in (0, 1)]
            low = high
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["row", "doc_id", "at", "side", "ids"])

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), body).mapInArrow(run, _EVENTS)


class Swept(NamedTuple):
    """What the machine found in stretches (one entry each)."""

    n: np.ndarray  # tokens of A, tokens of B, groups, links: a row each
    groups: list[bytes]
    pairs: list[np.ndarray]  # distinct pairs, A's id times 2^32 plus B's
    times: list[np.ndarray]


@lru_cache(maxsize=1)
def _decimals(n: int) -> np.ndarray:
    """The ids below ``n`` in decimal, closed to the right, 0 bytes before."""
    return np.array([str(i).rjust(7, "\0") for i in range(n)], "S7").view(np.uint8).reshape(n, 7)


def sweep(ids: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], n: int, lengths: tuple[np.ndarray, np.ndarray]) -> Swept:
    """Groups and links of ``n`` stretches; ``of`` gives the stretch of each token of either side, ascending."""
    a, b = (x.astype(np.int64) for x in ids)
    end_a, end_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])  # both sides have the same bytes
    at = np.searchsorted(end_b, end_a)
    last_a = end_b[np.minimum(at, len(end_b) - 1)] == end_a
    last_b = np.zeros(len(b), bool)
    last_b[at[last_a]] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    owner = of[0][last_a]
    sums = np.stack([
        np.bincount(of[0], minlength=n), np.bincount(of[1], minlength=n), np.bincount(owner, minlength=n),
        np.bincount(owner, per_a * per_b, minlength=n).astype(np.int64),
    ])
    # Text of the groups: tokens in order of group and side, a sign after each.
    size = 7 if max(len(lengths[0]), len(lengths[1])) < 10**7 else 0
    text = np.empty((len(a) + len(b), size + 1), np.uint8)
    before_b, before_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + before_a[group_b]
    digits = _decimals(max(len(lengths[0]), len(lengths[1])))
    text[place_a, :size], text[place_b, :size] = digits[a], digits[b]
    text[place_a, size] = np.where(last_a, ord("|"), ord(","))
    text[place_b, size] = np.where(last_b, ord(";"), ord(","))
    shown = text != 0
    stops = np.cumsum(np.r_[0, shown.sum(axis=1)])
    flat = text[shown].tobytes()
    tokens = np.cumsum(np.r_[0, sums[0] + sums[1]])
    cuts = stops[tokens].tolist()
    # Links: each token of A with all of B in its group.
    many = per_b[group_a]
    pair = np.repeat(a, many) << 32 | b[_places(before_b[group_a], many)]
    which = np.repeat(of[0], many)
    order = np.lexsort((pair, which))
    pair, which = pair[order], which[order]
    head = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (which[1:] != which[:-1])])
    times = np.diff(np.r_[head, len(pair)])
    edges = np.searchsorted(which[head], np.arange(1, n))
    return Swept(sums, [flat[x:y] for x, y in zip(cuts, cuts[1:])], np.split(pair[head], edges), np.split(times, edges))


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, text binary"


def alignments(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (side(a).lengths, side(b).lengths)
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # a stretch with both sides' ids
        state, first, size = _Document(), None, 0
        for batch in batches:
            for row, doc_id, at, k, packed in zip(*(c.to_pylist() for c in batch.columns[:4]), bodies(batch.column(4))):
                ids = _unpack(packed)
                if k == 0 and len(ids):
                    first = ids
                    continue
                held.append((row, doc_id, first if len(ids) else ids, ids))
                size += 2 * len(ids)
                if size > AT_ONCE:
                    yield from out(held, lengths, state)
                    held, size = [], 0
        yield from out(held, lengths, state)
        if state.row is not None:
            yield to_batch([state.close()])

    def out(held: list[tuple], lengths: tuple, state: _Document) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        of = tuple(np.repeat(np.arange(len(held)), [len(h[2 + k]) for h in held]) for k in (0, 1))
        found = sweep(tuple(np.concatenate([h[2 + k] for h in held]) for k in (0, 1)), of, len(held), lengths) if len(of[0]) else None
        rows = []
        for i, (row, doc_id, _, _) in enumerate(held):
            if row != state.row:
                if state.row is not None:
                    rows.append(state.close())
                state.open(row, doc_id)
            if found is not None:
                state.add(found, i)
        if rows:
            yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.int64()] * 5, pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in _DOCS.split(", ")])

    return runs.repartition("row").sortWithinPartitions("row", "at", "side").mapInArrow(run, _DOCS)


class _Document:
    """A document's sums over its stretches."""

    row: int | None = None

    def open(self, row: int, doc_id: int | None) -> None:
        self.row, self.doc_id, self.n = row, doc_id, np.zeros(4, np.int64)
        self.sha, self.pairs, self.times, self.tail = hashlib.sha256(), [], [], b""

    def add(self, found: Swept, i: int) -> None:
        if found.groups[i]:
            self.n += found.n[:, i]
            self.sha.update(self.tail + found.groups[i][:-1])  # the last sign only if more comes
            self.tail = b";"
            self.pairs.append(found.pairs[i])
            self.times.append(found.times[i])

    def close(self) -> tuple:
        pairs, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.pairs, self.times))
        if len(self.pairs) > 1:
            pairs, place = np.unique(pairs, return_inverse=True)
            times = np.bincount(place, times).astype(np.int64)
        steps = np.diff(pairs, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)
        planes = np.ascontiguousarray(np.c_[steps, times.astype("<u4").view(np.uint8).reshape(-1, 4)].T)
        return (self.doc_id, *self.n.tolist(), self.sha.hexdigest() if self.pairs else "", planes.tobytes())


def _pairs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' distinct pairs, how often each is linked there, and the document of each."""
    pairs, times = [], []
    for low, high in zip(block.starts.tolist(), block.ends.tolist()):
        planes = block.text[low:high].reshape(12, -1)
        pairs.append(np.cumsum(np.ascontiguousarray(planes[:8].T).reshape(-1).view("<u8")))
        times.append(np.ascontiguousarray(planes[8:].T).reshape(-1).view("<u4"))
    which = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    return (np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)).astype(np.uint64), np.concatenate(times).astype(np.int64) if times else np.zeros(0, np.int64), which


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` and ``b`` are vocabulary files (tokenizers .json, sentencepiece .model); A encodes a space and
    the text, B adds the space itself. Groups end where tokens of both end; a group's tokens of A and B
    are linked, each with each. A pair's count is the number of rows that hold it linked. ``n_best``
    counts links whose count is the highest of their A id, ``count_sum`` adds up the counts of all links.
    Null and empty texts, and texts whose tokens' bytes aren't a space and the text, have no tokens: zeros
    and an empty ``groups_sha256``. Repeated rows and null doc_ids stay, other columns are not read.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    blocks = make_blocks(alignments(events(docs, a, b), a, b), carry=names, level=6)
    buckets = buckets_for(blocks, 1 / 12)
    keys = lambda block: _pairs(block)[0] * _SPREAD
    answered = counted(blocks, keys, buckets, whole=True, keep=True)
    spark = docs.sparkSession

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(side(a).bytes), np.int64)
        for batch in batches:
            for block, parts in zip(read_blocks(batch), lists(batch, "totals")):
                own = np.unique(keys(block)) * _BACK >> np.uint64(32)
                np.maximum.at(most, own.astype(np.int64), totals_of(parts).astype(np.int64))
        id_ = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(most[id_])], ["id", "most"])

    # A row for each id of A at most.
    found = answered.mapInArrow(best, "id long, most long").groupBy("id").agg(F.max("most").alias("most")).toArrow()
    most = np.zeros(len(side(a).bytes), np.int64)
    most[found.column("id").to_numpy()] = found.column("most").to_numpy()
    shared = spark.sparkContext.broadcast(most)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, parts in zip(read_blocks(batch), lists(batch, "totals")):
                pairs, times, which = _pairs(block)
                count = totals_of(parts).astype(np.int64)[distinct_keys(pairs * _SPREAD, buckets, whole=True).place]
                highest = count == shared.value[(pairs >> np.uint64(32)).astype(np.int64)]
                n = len(block.ids)
                sums = np.zeros((2, n), np.int64)
                np.add.at(sums[0], which, times * highest)
                np.add.at(sums[1], which, times * count)
                columns = [pa.array(block.ids, mask=block.ids == NO_ID), *block.carried[:4], pa.array(sums[0]), pa.array(sums[1]), block.carried[4]]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return answered.mapInArrow(result, schema)
