"""Words of many texts as flat NumPy arrays, and hashed features of them.

A batch of texts becomes one array of code points; words are runs of letters. Everything after that
works on whole arrays, so a task costs a few array passes per batch whatever the texts look like.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Code points and texts per array batch; a longer text is a batch of its own. Some arrays have a row per text, so both bound memory.
CHARS, TEXTS = 1 << 18, 500
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)


@lru_cache(maxsize=2)
def _tables(digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it of a word, and its lower-case form (one code point, so offsets hold)."""
    test = str.isalnum if digits else str.isalpha
    letter = np.fromiter((test(chr(c)) for c in range(0x110000)), dtype=bool, count=0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        s = chr(c).lower()
        if len(s) == 1:
            lower[c] = ord(s)
    return letter, lower


@dataclass
class Words:
    """`codes`: lower-cased code points of all texts; a word is `codes[start:end]` of text `doc`."""
    codes: np.ndarray
    letter: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    base: np.ndarray
    n_docs: int


def split(texts: list[str], digits: bool = False) -> Words:
    """The words of all texts: runs of letters, or of letters and digits."""
    letter_of, lower_of = _tables(digits)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    letter = letter_of[codes]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(codes) and letter[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the text ends with a line feed, so edges are paired
    doc = np.searchsorted(base, start, side="right") - 1
    return Words(lower_of[codes], letter, start, end, doc, base[:-1], len(texts))


def batches(texts: list[str | None], chars: int = CHARS):
    """`(first, texts)` runs of about `chars` code points and at most `TEXTS` texts; null counts as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and (size + len(t) > chars or len(held) == TEXTS):
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _fold(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _PRIME
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def affix_hashes(w: Words, lengths: tuple[int, ...], bits: int, suffix: bool = False) -> list[np.ndarray]:
    """One hash per word and length: the first (last) letters; a shorter word hashes as it is."""
    size = w.end - w.start
    h = np.full(len(size), 7 if suffix else 3, dtype=np.uint64)
    out = []
    for j in range(max(lengths)):
        at = np.maximum(w.end - 1 - j, 0) if suffix else np.minimum(w.start + j, len(w.codes) - 1)
        h = h * _PRIME + np.where(j < size, w.codes[at], 0).astype(np.uint64) + np.uint64(1)
        if j + 1 in lengths:
            out.append(_fold(h + np.uint64(j * 131), bits))
    return out


def word_hash(w: Words) -> np.ndarray:
    """A 64-bit hash of each whole word."""
    size = w.end - w.start
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    power = np.cumprod(np.full(size.max(), 0x100000001B3, dtype=np.uint64))
    h = np.add.reduceat((w.codes[w.letter].astype(np.uint64) + np.uint64(1)) * power[place], first)
    return (h ^ (h >> np.uint64(29))) * _PRIME


def fold(h: np.ndarray, bits: int, salt: int) -> np.ndarray:
    return _fold(h + np.uint64(salt * int(_PRIME) % (1 << 64)), bits)


def trigrams(w: Words, bits: int) -> np.ndarray:
    """A hash for each letter of each word: it and its two neighbours, what is no letter counting as an edge."""
    c = np.where(w.letter, w.codes, 0).astype(np.uint64)
    at = np.flatnonzero(w.letter)
    left, right = np.where(at > 0, c[np.maximum(at - 1, 0)], 0), c[np.minimum(at + 1, len(c) - 1)]
    return _fold((left * np.uint64(0x1F3D5B79) + c[at]) * np.uint64(0x2545F4914F6CDD1D) + right, bits)


def chains(w: Words, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """`(first word, number of words)` of each chain: a sentence or line, cut after `longest` words."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.isin(w.codes, _ENDS)
    seen = np.cumsum(ends)
    new = np.ones(n, dtype=bool)
    new[1:] = seen[w.start[1:]] > seen[w.start[:-1]]
    sentence = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(sentence, np.diff(np.append(sentence, n)))
    first = np.flatnonzero(place % longest == 0)
    return first, np.diff(np.append(first, n))
