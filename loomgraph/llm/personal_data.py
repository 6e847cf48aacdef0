"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds to them.

The field scores whole candidate spans (all digits of a span, its groups, its check digit, what stands
around it) and picks the best set of spans that don't overlap, boundaries and kinds together, by dynamic
programming. A span has bounded size, so the work grows with the text. What no span covers scores
nothing, so a span is added only if the field is for it.

The weights are learnt from the patterns' own matches in a bounded sample of passages, as they stand,
written in other ways, and with dates and other numbers in their place; likelihood and gradient go over
all segmentations of a passage.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bodies

KINDS = ("email", "ip", "card", "phone")
#: Passages with and without matches that the field is fitted on, at most; and the characters around a match.
SAMPLE, AROUND = 400, 40
#: Bounds of a candidate: digits, groups of digits, characters between two groups, characters of an email.
DIGITS, GROUPS, BETWEEN, EMAIL = 19, 8, 3, 120
EPOCHS, RATE, DECAY = 8, 0.3, 0.002

# The patterns' character classes and bounds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: from the run's beginning it would match as well.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]|[([{] ?(?:at|AT|At) ?[])}]")


class Span(NamedTuple):
    start: int
    rank: int  # of the kind
    end: int


def _digits(text: str) -> str:
    return "".join(re.findall("[0-9]", text))


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, looked for from each @, in time that grows with the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if size else None
        if found:
            yield at - size, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, in order."""
    if not _ANY.search(text):
        return []
    out = [Span(a, 0, b) for a, b in emails(text)]
    out += [Span(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(Span(m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


# ---- candidates and features

_RUN = re.compile("[0-9]+")
_GAP = re.compile(r"[ \-.()/\[\] ‐-―]+")
_AT = r" ?(?:@|[(\[{] ?(?:at|AT|At) ?[)\]}]) ?"
_DOT = r" ?(?:\.|[(\[{] ?(?:dot|DOT|Dot) ?[)\]}]) ?"
_LOOSE_EMAIL = re.compile(rf"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,4}}")
_SIGN = re.compile(_AT)
_WORD = re.compile(r"(\w+)\W*$")


def candidates(text: str, low: int, high: int) -> list[Span]:
    """Spans between ``low`` and ``high`` that may be personal data, whatever way they are written."""
    out = []
    for sign in _SIGN.finditer(text, low, high):
        local = text[max(low, sign.start() - 64) : sign.start()]
        start = sign.start() - (len(local) - len(local.rstrip(_LOCAL)))
        found = _LOOSE_EMAIL.match(text, start, min(high, start + EMAIL))
        if found and _apart(text, start, found.end()):
            out.append(Span(start, 0, found.end()))
    runs = [m.span() for m in _RUN.finditer(text, low, high)]
    for i, (start, _) in enumerate(runs):
        if start and text[start - 1].isalnum():
            continue
        while start > low and text[start - 1] in "+(":
            start -= 1
        n, small = 0, True
        for k, (a, b) in enumerate(runs[i : i + GROUPS]):
            if k and not (a - runs[i + k - 1][1] <= BETWEEN and _GAP.fullmatch(text, runs[i + k - 1][1], a)):
                break
            n += b - a
            if n > DIGITS:
                break
            small &= _small(text[a:b])
            if not _apart(text, start, b):
                continue
            if k == 3 and small:
                out.append(Span(start, 1, b))
            if n >= 14:
                out.append(Span(start, 2, b))
            if 10 <= n <= 15:
                out.append(Span(start, 3, b))
    return sorted(set(out))


def _apart(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum() or text[end : end + 1].isalnum())


def _class(c: str) -> str:
    return "a" if c.isalpha() else "0" if c.isdigit() else "_" if c.isspace() or not c else c


def features(text: str, span: Span) -> list[str]:
    """What the field knows of a whole span."""
    kind, own = KINDS[span.rank], text[span.start : span.end]
    left, right = _class(text[max(span.start - 1, 0) : span.start]), _class(text[span.end : span.end + 1])
    word = _WORD.search(text[max(0, span.start - 24) : span.start])
    out = ["", f"left {left}", f"right {right}", f"word {word[1].lower() if word else ''}"]
    if span.rank == 0:
        sign = _SIGN.search(own)
        out += [f"sign {sign[0].strip().lower() == '@'}", f"spaced {' ' in own}", f"dots {own.count('.')}", f"ends {len(re.findall('[A-Za-z0-9]+', own)[-1])}"]
    else:
        groups = re.findall("[0-9]+", own)
        digits = "".join(groups)
        gaps = {re.sub("[0-9]+", "", g) for g in re.split("[0-9]+", own)[1:-1]}
        out += [f"number {len(groups)}", f"first {_class(own[0])}", f"gaps {len(gaps)}"]
        if span.rank != 1:  # an address may have any digits
            out += [f"digits {len(digits)}", f"groups {' '.join(str(len(g)) for g in groups)}", f"luhn {luhn(digits)}", f"even {len(set(map(len, groups))) == 1}"]
        out += [f"gap {g}" for g in sorted(gaps)]
    return [f"{kind} {x}" for x in out]


# ---- the field


class Passage(NamedTuple):
    """Candidates of a passage over its boundaries, and which of them are true."""

    begins: list[int]
    ends: list[int]
    boundaries: int
    features: list[list[int]]
    true: list[bool]


def passage(spans: list[Span], known: list[list[int]], true: set[Span]) -> Passage:
    edges = sorted({x for s in spans for x in (s.start, s.end)})
    at = {x: i for i, x in enumerate(edges)}
    return Passage([at[s.start] for s in spans], [at[s.end] for s in spans], len(edges), known, [s in true for s in spans])


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def marginals(own: Passage, scores: list[float]) -> tuple[float, list[float]]:
    """Logarithm of the sum over all segmentations, and each candidate's probability."""
    n = own.boundaries
    ahead, back = [-math.inf] * n, [-math.inf] * n
    ahead[0] = back[-1] = 0.0
    by_end: dict[int, list[int]] = {}
    by_begin: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(own.begins, own.ends)):
        by_end.setdefault(b, []).append(i)
        by_begin.setdefault(a, []).append(i)
    for j in range(1, n):
        ahead[j] = ahead[j - 1]
        for i in by_end.get(j, ()):
            ahead[j] = _add(ahead[j], ahead[own.begins[i]] + scores[i])
    for j in range(n - 2, -1, -1):
        back[j] = back[j + 1]
        for i in by_begin.get(j, ()):
            back[j] = _add(back[j], back[own.ends[i]] + scores[i])
    return ahead[-1], [math.exp(ahead[a] + s + back[b] - ahead[-1]) for a, b, s in zip(own.begins, own.ends, scores)]


def best_segmentation(own: Passage, scores: list[float]) -> list[int]:
    """The candidates of the best segmentation; none is taken that adds nothing."""
    n = own.boundaries
    best, taken = [0.0] * n, [-1] * n
    by_end: dict[int, list[int]] = {}
    for i, b in enumerate(own.ends):
        by_end.setdefault(b, []).append(i)
    for j in range(1, n):
        best[j] = best[j - 1]
        for i in by_end.get(j, ()):
            if (s := best[own.begins[i]] + scores[i]) > best[j]:
                best[j], taken[j] = s, i
    out, j = [], n - 1
    while j > 0:
        i = taken[j]
        j = j - 1 if i < 0 else own.begins[i]
        out += [i] if i >= 0 else []
    return out[::-1]


class Field:
    """Weights by feature."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, text: str, span: Span) -> float:
        weight = self.weights.get
        return sum(weight(f, 0.0) for f in features(text, span))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans beside ``base`` that the field is for."""
        out = []
        for low, high in zones(text, base):
            spans = candidates(text, low, high)
            if spans:
                own = passage(spans, [], set())
                out += [spans[i] for i in best_segmentation(own, [self.score(text, s) for s in spans])]
        return out


def zones(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches without a base span that hold digits or a sign of an email."""
    at = 0
    for span in [*base, Span(len(text), 0, len(text))]:
        if span.start > at and _ANY.search(text, at, span.start):
            yield at, span.start
        at = max(at, span.end)


def fit(passages: list[tuple[str, list[Span]]]) -> Field:
    """The field that makes the true spans of ``passages`` likely (AdaGrad on the penalised likelihood)."""
    names: dict[str, int] = {}
    learnt = []
    for text, true in passages:
        spans = candidates(text, 0, len(text))
        if spans:
            known = [[names.setdefault(f, len(names)) for f in features(text, s)] for s in spans]
            learnt.append(passage(spans, known, set(true)))
    weights, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(EPOCHS):
        for own in learnt:
            _, chance = marginals(own, [float(weights[k].sum()) for k in own.features])
            step: dict[int, float] = {}
            for k, p, true in zip(own.features, chance, own.true):
                for f in k:
                    step[f] = step.get(f, 0.0) + true - p
            at, by = np.fromiter(step, np.int64), np.fromiter(step.values(), float)
            by = by - DECAY * weights[at]
            seen[at] += by * by
            weights[at] += RATE * by / np.sqrt(seen[at])
    return Field(dict(zip(names, weights.tolist())))


# ---- the sample


def rewritten(text: str, span: Span, way: int) -> tuple[str, Span]:
    """``text`` with the span written in another way, and where it is then."""
    own = text[span.start : span.end]
    if span.rank == 0:
        name, _, host = own.rpartition("@")
        own = [f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} @ {host}"][way]
    elif span.rank == 1:
        own = own.replace(".", ["[.]", "(.)", " . "][way])
    elif span.rank == 2:
        d = _digits(own)
        own = [".", " / ", " "][way].join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        d = _digits(own)
        own = [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"+{d[:-7]}/{d[-7:-4]}/{d[-4:]}"][way]
    return text[: span.start] + own + text[span.end :], Span(span.start, span.rank, span.start + len(own))


#: Ways of ``rewritten`` and of ``impersonal``.
WAYS = 3, 5


def impersonal(text: str, span: Span, way: int) -> str:
    """``text`` with numbers in the span's place that aren't personal: dates, a number, a failing card, an amount."""
    seed = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    n = [seed >> shift & 0xFFFF for shift in (0, 16, 32, 48)]
    day = f"{1990 + n[0] % 40}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d}"
    time = f"{n[3] % 24:02d}:{n[0] % 60:02d}:{n[1] % 60:02d}"
    plain = str(10**9 + seed % 10**10)
    wrong = str(10**14 + seed % 10**14)
    wrong += next(c for c in "0123456789" if not luhn(wrong + c))
    own = [f"{day} {time}", f"{day[8:]}.{day[5:7]}.{day[:4]} - {day[5:7]}.{day[:4]}", plain, wrong, f"{n[0]} {n[1]:05d}.{n[2] % 100:02d}"][way]
    return text[: span.start] + own + text[span.end :]


def _passages(text: str) -> Iterator[tuple[int, str]]:
    """Passages around matches (1) and around other digits (0)."""
    base = base_spans(text)
    for span in base:
        yield 1, text[max(0, span.start - AROUND) : span.end + AROUND]
    for low, high in zones(text, base):
        if found := _ANY.search(text, low, high):
            yield 0, text[max(0, found.start() - AROUND) : found.end() + AROUND]


def sample(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """Up to ``size`` passages with matches and as many without: those of the least hash, so the order of rows has no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict[int, str]] = {0: {}, 1: {}}
        for batch in batches:
            for body in bodies(batch.column(0)):
                for kind, text in _passages(body.decode()):
                    least[kind][xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1] = text
            for kind, held in least.items():
                least[kind] = dict(heapq.nsmallest(size, held.items()))
        rows = [(kind, mark, text) for kind, held in least.items() for mark, text in held.items()]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["kind", "mark", "text"])

    found = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).mapInArrow(run, "kind int, mark long, text string")
    out = []
    for kind in (0, 1):
        out += [r.text for r in found.filter(F.col("kind") == kind).dropDuplicates(["mark"]).orderBy("mark").limit(size).collect()]
    return out


def trained(docs: DataFrame, size: int = SAMPLE) -> Field:
    passages = []
    for text in sample(docs, size):
        base = base_spans(text)
        passages.append((text, base))
        if len(base) == 1:
            passages += [(new, [span]) for new, span in (rewritten(text, base[0], way) for way in range(WAYS[0]))]
            passages += [(new, base_spans(new)) for new in (impersonal(text, base[0], way) for way in range(WAYS[1]))]
    return fit(passages)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.rank]}:{s.start}:{s.end}" for s in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and ``base_sha256`` are those of the patterns, ``spans`` has the field's as well, as
    kind:start:end in code points, by start and kind. The field adds nothing that overlaps a pattern's
    match; without one given it is ``trained`` on ``docs``. Null and empty texts have no spans. Repeated
    rows and null doc_ids stay; other columns are not read.
    """
    field = field or trained(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)
    counts = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(shared.value)
        for batch in batches:
            rows = []
            for body in bodies(batch.column(1)):
                text = body.decode()
                base = base_spans(text)
                added = own.added(text, base)
                n = [sum(s.rank == k for s in base) for k in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + added)), len(added)))
            columns = list(zip(*rows)) or [[]] * 7
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *counts, "base_sha256", "spans", "n_added"])

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body).mapInArrow(run, schema)
