"""Token ids of many texts by a byte-level BPE, each distinct piece encoded once per worker.

The tokenizer first cuts a text into pieces (words with their leading space, numbers, signs, runs of
white space) and encodes every piece by itself. The cuts are found here on arrays of code points;
the library encodes only pieces that the worker has not met yet, and a text's ids are
looked up by piece.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
_PRIME = np.uint64(0x100000001B3)
#: Pieces kept in a worker; beyond it the table starts again. A batch with more of them is held whole.
KNOWN = 2_000_000
#: Pieces handed to the library at once.
SLICE = 4096
#: Longer pieces are encoded each time they occur.
PIECE = 64


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, from its Unicode category and the white space of the pattern."""
    import unicodedata

    kind = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group == "L":
            kind[c] = _LETTER
        elif group == "N":
            kind[c] = _NUMBER
    for lo, hi in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                   (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        kind[lo:hi + 1] = _SPACE
    return kind


def piece_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Offsets at which the pieces of the concatenated texts begin."""
    n = len(codes)
    kind = _classes()[codes]
    fresh = np.zeros(n, dtype=bool)
    fresh[text_starts] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= fresh
    starts = change.copy()
    space = kind == _SPACE
    last = np.ones(n, dtype=bool)  # last code point of its run or text
    last[:-1] = change[1:]
    ends_text = np.ones(n, dtype=bool)
    ends_text[:-1] = fresh[1:]
    # white space before something else gives up its last code point ...
    tail = space & last & ~ends_text
    starts |= tail
    # ... and a plain space joins what follows it
    joined = np.flatnonzero(tail & (codes == 0x20))
    starts[joined + 1] = False
    # contractions: an apostrophe that would begin a piece, and the letters it takes
    for at in np.flatnonzero((codes == 0x27) & starts).tolist():
        run = 1
        while at + run < n and run < 3 and not fresh[at + run]:
            run += 1
        follow = "".join(map(chr, codes[at + 1:at + run].tolist()))
        take = 1 if follow[:1] in tuple("stmd") and follow else 2 if follow in ("re", "ve", "ll") else 0
        if take:
            starts[at + 1:at + 1 + take] = False
            after = at + 1 + take
            if after < n:
                starts[after] = True
                if space[after] and last[after] and not ends_text[after] and codes[after] == 0x20:
                    starts[after + 1] = False
    return np.flatnonzero(starts)


class Encoder:
    """Ids of texts by the tokenizer file at `path`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces and enter them in the table; both sorted by key."""
        got = []
        for at in range(0, len(pieces), SLICE):  # the library's results are many times larger than the ids
            got += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at:at + SLICE], add_special_tokens=False)]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        slots = np.arange(len(self.first) - 1, len(self.first) - 1 + len(got))
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), dtype=np.uint32, count=size.sum())])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        at = np.searchsorted(self.keys, keys)  # both sorted
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`(ids, counts)`: the ids of all texts one after the other, and how many each text has."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        text_starts = (np.cumsum(sizes) - sizes)
        start = piece_starts(codes, text_starts[sizes > 0])
        size = np.diff(np.append(start, len(codes)))
        place = np.arange(len(codes)) - np.repeat(start, size)
        power = np.cumprod(np.full(PIECE + 1, _PRIME, dtype=np.uint64))
        key = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, PIECE)], start)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        key[size > PIECE] = 0  # too long for a key that tells pieces apart
        uniq, where, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        missing = (self.keys[at] != uniq) if len(self.keys) else np.ones(len(uniq), bool)
        missing &= uniq != 0
        if missing.any():
            if len(self.keys) + missing.sum() > KNOWN:  # the table starts again, with all pieces of this batch
                self._forget()
                missing = uniq != 0
            new = np.flatnonzero(missing)
            self._add(uniq[new], [joined[start[w]:start[w] + size[w]] for w in where[new].tolist()])
        slot = np.zeros(len(uniq), np.int64)
        if len(self.keys):
            slot = self.slots[np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)]
        count, first = (self.first[slot + 1] - self.first[slot])[back], self.first[slot][back]
        source = self.ids
        long = np.flatnonzero(size > PIECE)
        if len(long):
            got = [self.tokenizer.encode(joined[start[i]:start[i] + size[i]], add_special_tokens=False).ids for i in long.tolist()]
            count[long] = [len(x) for x in got]
            first[long] = len(source) + np.cumsum(count[long]) - count[long]
            source = np.concatenate([source, np.fromiter((i for x in got for i in x), dtype=np.uint32)])
        ends = np.cumsum(count)
        ids = source[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        of_text = np.searchsorted(text_starts, start, side="right") - 1
        return ids, np.bincount(of_text, weights=count, minlength=len(texts)).astype(np.int64)
