"""Language identification with string kernels.

Two texts are compared by the n-grams of 1 to 3 bytes that occur in both (presence, not frequency),
over the geometric mean of what each has: a blended-spectrum kernel. N-grams are told apart by a hash
into ``GRAMS`` slots; those of one slot count as one. Landmarks give a Nyström map of
the kernel, and one-versus-rest kernel ridge regression in that space a score for each language.
Since the kernel is a product of presence vectors, landmarks, map and regression fold into one
matrix, and a batch of texts is scored by one product with it.

Training takes a bounded sample: at most ``PER_LANGUAGE`` labelled rows of each of at most
``LANGUAGES`` languages, chosen by a hash. Tasks map the sample and add up the normal equations; the
driver holds the landmarks and two small matrices. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bodies, by_place, saved

PER_LANGUAGE, LANGUAGES = 500, 256
LANDMARKS = 256
GRAMS = 1 << 14
RIDGE = 1e-2
#: Tasks that add up the normal equations.
TASKS = 16
#: How sharply scores become probabilities.
SHARPNESS = 6.0
UNDETERMINED = "und"

_SIGNS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # GRAMS x languages


def presence(text: str) -> np.ndarray:
    """Which n-grams of 1 to 3 bytes occur in the lower-cased text, signs and digits being spaces."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_SIGNS) + b" ", np.uint8).astype(np.uint32)
    found = np.zeros(GRAMS, bool)
    code = data
    for n in range(1, 4):
        found[_slot(code, n)] = True
        if n < 3:
            code = code[:-1] << np.uint32(8) | data[n:]
    return found


def _slot(code: np.ndarray, n: int) -> np.ndarray:
    # Fixed value: an odd multiplier that mixes low bits into the high ones kept.
    return (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 14)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def normed(grams: np.ndarray) -> np.ndarray:
    x = grams.astype(np.float64)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Nystrom(NamedTuple):
    marks: np.ndarray  # the landmarks' normed n-grams
    whiten: np.ndarray  # from kernels with the landmarks to the map


def nystrom(grams: np.ndarray) -> Nystrom:
    marks = normed(grams)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-8 * values[-1]
    return Nystrom(marks, vectors[:, keep] / np.sqrt(values[keep]))


def landmarks(n: int) -> np.ndarray:
    """Places of the landmarks among ``n`` rows in order of language and hash."""
    return np.unique(np.linspace(0, n - 1, min(LANDMARKS, n)).round().astype(int))


def equations(space: Nystrom, grams: np.ndarray, language: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What some rows add to both sides of the normal equations; languages weigh the same."""
    phi = normed(grams) @ space.marks.T @ space.whiten
    own = phi / counts[language][:, None]
    y = np.where(language[:, None] == np.arange(len(counts)), 1.0, -1.0)
    return phi.T @ own, own.T @ y


def solved(space: Nystrom, left: np.ndarray, right: np.ndarray, languages: list[str]) -> Model:
    beta = np.linalg.solve(left + RIDGE * len(languages) * np.eye(len(left)), right)
    return Model(languages, (space.marks.T @ (space.whiten @ beta)).astype(np.float32))


def fit(labels: list[str], grams: np.ndarray) -> Model:
    """Ridge regression on the Nyström map of the rows of ``grams`` (presence, one row a text), in one place."""
    languages, language, counts = np.unique(np.array(labels, str), return_inverse=True, return_counts=True)
    if not len(languages):
        return Model([], np.zeros((GRAMS, 0), np.float32))
    space = nystrom(grams[landmarks(len(grams))])
    return solved(space, *equations(space, grams, language, counts), languages.tolist())


def score(model: Model, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its probability for each row of ``grams``."""
    x = grams.astype(np.float32)
    raw = SHARPNESS * (x @ model.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    best = raw.argmax(axis=1)
    return best, np.clip(e[np.arange(len(e)), best] / e.sum(axis=1), 0, 1)


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and lang of rows that aren't held out, have a lang and have a letter."""
    spark = docs.sparkSession
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit([], np.zeros((0, GRAMS), bool))
    # Twice as many as needed are drawn by hash; texts without letters may be among them.
    share = {r["lang"]: min(1.0, 2 * per_language / r["count"]) for r in counts}
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    mark = F.pmod(F.xxhash64("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.lit(1 << 30))
    drawn = rows.filter(F.col("lang").isin(list(share))).select("lang", mark.alias("mark"), F.col("text").cast("binary").alias("body"))
    drawn = drawn.filter(F.col("mark") < rate * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode() for b in bodies(batch.column("body"))]
            good = [i for i, t in enumerate(texts) if has_letter(t)]
            bits = pa.array([np.packbits(presence(texts[i])).tobytes() for i in good], pa.binary())
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), bits], ["lang", "mark", "bits"])

    by_hash = Window.partitionBy("lang").orderBy("mark", "bits")
    ranked = drawn.mapInArrow(run, "lang string, mark long, bits binary").withColumn("rank", F.row_number().over(by_hash))
    sample = saved(ranked.filter(F.col("rank") <= per_language).select("lang", "rank", "bits"), "language-sample")
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return fit([], np.zeros((0, GRAMS), bool))
    counts = np.array([sizes[name] for name in languages])
    before = np.cumsum(counts) - counts
    places = landmarks(int(counts.sum()))
    of = np.searchsorted(before, places, "right") - 1
    chosen = spark.createDataFrame([(languages[k], int(at - before[k]) + 1) for k, at in zip(of, places)], "lang string, rank int")
    marks = sample.join(F.broadcast(chosen), ["lang", "rank"]).orderBy("lang", "rank").collect()  # at most LANDMARKS rows
    space = nystrom(_unpacked([r["bits"] for r in marks]))
    number = {name: k for k, name in enumerate(languages)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((space.whiten.shape[1],) * 2), np.zeros((space.whiten.shape[1], len(counts)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                language = np.array([number[name] for name in part.column("lang").to_pylist()])
                a, b = equations(space, _unpacked(part.column("bits").to_pylist()), language, counts)
                left, right = left + a, right + b
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in (left, right)], ["left", "right"])

    # Sorted, so that sums come out alike each time; a row of two matrices for each of a few tasks.
    parts = sample.repartition(TASKS).sortWithinPartitions("lang", "rank").mapInArrow(add, "left binary, right binary").collect()
    left, right = (sum(np.frombuffer(r[side]) for r in parts) for side in ("left", "right"))
    r = space.whiten.shape[1]
    return solved(space, left.reshape(r, r), right.reshape(r, -1), languages)


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(bool)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the whole text alone.

    A text that is null or has no letter gives ``und`` with score 0, as does any text if no row could
    be learnt from. Rows stay as they are, repeated or with a null doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield of(whole.slice(at, 256))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
        texts = [b.decode() for b in bodies(batch.column(2))]
        good = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
        if good:
            best, p = score(model, np.stack([presence(texts[i]) for i in good]))
            scores[good] = p
            for i, k in zip(good, best.tolist()):
                names[i] = model.languages[k]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), body)
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a language is found for; a null ``lang`` becomes that language.

    Rejected are texts that are null or have no letter, and nothing else; if there is no row to
    learn from, a null ``lang`` stays. Columns, other values and repeats stay.
    """
    model = train(docs)
    names = docs.columns
    at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                yield of(whole.slice(first, 256))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        keep = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        found = batch.take(pa.array(keep, pa.int64()))
        if not keep or not model.languages:
            return found
        best, _ = score(model, np.stack([presence(texts[i]) for i in keep]))
        lang = [own if own is not None else model.languages[k] for own, k in zip(found.column(lang_at).to_pylist(), best.tolist())]
        return found.set_column(lang_at, found.schema.names[lang_at], pa.array(lang, pa.string()))

    schema = by_place(docs)
    return docs.toDF(*schema.names).mapInArrow(run, schema).toDF(*names)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
