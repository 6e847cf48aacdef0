"""Byte-pair encoding by last-token states, shared by the token operators.

The encoding of a prefix is the encoding of a shorter prefix plus one token, its last token. A token
may stand after another exactly if the two encode to themselves when joined, so the last token of
each prefix is the one candidate that ends there and may follow the last token of the prefix before
it. Distinct words, sorted, are a trie walked depth first: a word goes on from the states of the
prefix that it shares with the word before it, which are computed once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

#: Words kept with their encodings before the table starts anew; bounds a task's memory.
CACHE_WORDS = 1_000_000
_MAX_ID = 1 << 20
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The character for each byte in the vocabulary files: itself if visible, else from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        back = {c: b for b, c in enumerate(byte_characters())}
        ids = model["vocab"]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {} if self.end else self.inner
        self.merges = {}
        for rank, (x, y) in enumerate(model["merges"]):
            self.merges.setdefault((ids[x], ids[y]), (rank, ids[x + y]))
        single = [ids[c] for c in byte_characters()]
        single_end = [ids[c + self.end] for c in byte_characters()]
        self.symbols: dict[int, list[int]] = {}
        for token, i in ids.items():
            closing = bool(self.end) and token.endswith(self.end) and token != self.end
            raw = token[: -len(self.end)] if closing else token
            if all(c in back for c in raw):
                raw = bytes(back[c] for c in raw)
                self.symbols[i] = [single[x] for x in raw[:-1]] + [(single_end if closing else single)[raw[-1]]]
                (self.final if closing else self.inner)[raw] = i
        self.longest = max(map(len, self.inner))
        self.longest_final = max(map(len, self.final))
        self.follows: dict[int, bool] = {}
        self.sides: dict[int, tuple[list, list] | None] = {}

    def edges(self, token: int) -> tuple[list, list] | None:
        """The symbols at the left and right edge of a token while it forms, each with the rank of the
        merge that takes it up; None if the token's text doesn't encode to the token."""
        if token in self.sides:
            return self.sides[token]
        parts, left, right = list(self.symbols[token]), [], []
        while len(parts) > 1:
            best = min(((self.merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=None)
            if best is None:
                break
            (rank, merged), i = best
            if i == 0:
                left.append((parts[0], rank))
            if i == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[i : i + 2] = [merged]
        left.append((token, _NEVER))
        right.append((token, _NEVER))
        self.sides[token] = (left, right) if parts == [token] else None
        return self.sides[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` encode to themselves when joined; ``a`` is -1 at the start of a word.

        Merges are done by rank. One across the border happens if its rank comes before both of the
        merges that take up the symbols beside the border (of equal merges the left one goes first).
        """
        key = a * _MAX_ID + b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        after = self.edges(b)
        if a < 0 or after is None:
            return after is not None
        right, left = self.edges(a)[1], after[0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            across = self.merges.get((x, y))
            if across and across[0] < x_ends and across[0] <= y_ends:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def walk(self, words: list[bytes]) -> Iterable[tuple[bytes, list[int], list[int]]]:
        """Each of the sorted distinct non-empty ``words`` with its ids and, by prefix, its token count.

        ``counts[i]`` is the number of tokens of the first ``i`` bytes on their own (as the inside of
        a word where the vocabulary marks word ends); the lists are reused, so copy what is kept.
        """
        size = max(map(len, words), default=0) + 1
        last, start, counts = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        last[0] = -1
        inner, follows, longest = self.inner.get, self.follows.get, self.longest
        final, marked = self.final, bool(self.end)
        before, known = b"", 0
        for word in words:
            n = len(word)
            depth, most = 0, min(known, n)
            if before[:most] == word[:most]:
                depth = most
            else:
                while before[depth] == word[depth]:
                    depth += 1
            stop = n - 1 if marked else n
            for i in range(depth + 1, stop + 1):
                for j in range(i - longest if i > longest else 0, i):
                    token = inner(word[j:i])
                    if token is not None:
                        ok = follows(last[j] * _MAX_ID + token)
                        if ok is None:
                            ok = self.may_follow(last[j], token)
                        if ok:
                            last[i], start[i], counts[i] = token, j, counts[j] + 1
                            break
            before, known = word, max(stop, min(depth, n))
            ids, at = [], n
            if marked:
                for j in range(max(0, n - self.longest_final), n):
                    token = final.get(word[j:])
                    if token is not None and self.may_follow(last[j], token):
                        ids.append(token)
                        at = j
                        break
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            yield word, ids, counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---- splitting text into words


@lru_cache(maxsize=1)
def classes() -> tuple[str, str, str]:
    """Ranges, for use within [], of letters, numbers and white space, as the library's patterns have them.

    Python's own tables are of another version of Unicode. Planes without characters, and those for
    private use, hold none of the three.
    """
    from tokenizers import Regex, pre_tokenizers

    points = [i for i in [*range(0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= i < 0xE000]
    text = "".join(map(chr, points))

    def ranges(others: str) -> str:
        found = pre_tokenizers.Split(Regex(others), "removed").pre_tokenize_str(text)
        return "".join(f"\\U{points[low]:08x}-\\U{points[high - 1]:08x}" for _, (low, high) in found)

    return ranges(r"[^\p{L}]+"), ranges(r"[^\p{N}]+"), ranges(r"[^\s]+")


@lru_cache(maxsize=1)
def _library_normal() -> Callable[[str], str]:
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


@lru_cache(maxsize=200_000)
def normal(word: str) -> str:
    """NFC and lower case of a word by the library; a space never joins with what follows, so words stand alone."""
    return _library_normal()(word)


ASCII = ("A-Za-z", "0-9", "\\t-\\r ")


@lru_cache(maxsize=4)
def byte_level_pattern(ascii_only: bool) -> re.Pattern:
    """Fixed pattern of the byte-level files: contractions, words, numbers, marks, white space.

    The frequent kinds come first; which is first doesn't matter, as no two of the first three begin alike.
    """
    letter, digit, space = ASCII if ascii_only else classes()
    return re.compile(
        f" ?[{letter}]+| ?[{digit}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


@lru_cache(maxsize=4)
def lower_case_pattern(ascii_only: bool) -> re.Pattern:
    """Fixed pattern of the lower-case file: contractions, words, single digits, marks."""
    letter, digit, space = ASCII if ascii_only else classes()
    return re.compile(f"[{letter}]+|[{digit}]|'(?:[stmd]|re|ve|ll)|[^{space}{letter}{digit}]+")


@lru_cache(maxsize=2)
def stretch_pattern(ascii_only: bool) -> re.Pattern:
    """White space and what follows up to the next white space; the frequent kind, after one space, comes first."""
    space = ASCII[2] if ascii_only else classes()[2]
    return re.compile(f" [^{space}]+|[{space}]*[^{space}]+|[{space}]+")


def stretches(text: str) -> list[str]:
    """The text cut before white space that follows something else; words of any file's pattern lie within the parts."""
    return stretch_pattern(text.isascii()).findall(text)


def byte_level_words(text: str) -> list[str]:
    return byte_level_pattern(text.isascii()).findall(text)


def lower_case_words(text: str) -> list[str]:
    """Words after NFC and lower-casing by character."""
    if text.isascii():
        return lower_case_pattern(True).findall(text.lower())
    text = " ".join([part.lower() if part.isascii() else normal(part) for part in text.split(" ")])
    return lower_case_pattern(False).findall(text)


def around_special(text: str, special: dict[str, int]) -> list[str]:
    """The text cut so that odd places hold special tokens."""
    if not any(s in text for s in special):
        return [text]
    return re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
