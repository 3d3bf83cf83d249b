"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine.

The rules of a merge list apply in the order of their ranks, so text further right changes an earlier
token only through a chain of merges with growing ranks: a merge that takes a token away from its left
neighbour lets that neighbour merge otherwise, but only by a later rule, and so on leftwards. The longest such
chain, in bytes, is the list's lookahead (`reach`): a token that ends at least that far before the end of
what has been read is the same whatever follows. The transducer holds a window of that length and a
fixed block, emits the tokens that are stable, and forgets their bytes.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Marks the last byte of a word in the vocabulary.
WORD_END = "</w>"
#: Symbols read beyond the lookahead before stable tokens are sought.
BLOCK = 4096


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte in a byte-level vocabulary: a byte that prints stands for itself,
    the others take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class MergeList:
    """Ranks, results and lookahead of the merges of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in {**self.vocab, **self.specials}.items()}
        self.special_ids = frozenset(self.specials.values())
        self.end = model.get("end_of_word_suffix") or WORD_END
        # (left id, right id) -> (rank, id of both together)
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.size = {i: 1 for i in (*self.inner, *self.last)}
        for (a, b), (_, both) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            self.size.setdefault(both, self.size[a] + self.size[b])
        self.reach = self._reach()

    def _reach(self) -> int:
        """Bytes before the end of what was read that later text can still change.

        A chain goes from a merge `(x, t)` to a later one `(y, u)` whose right part `u` is `x` or has `x` at its left edge; it
        reaches over the left parts. Merges are met from the last rank to the first, so one pass is enough.
        """
        left = {}
        for (a, _), (rank, both) in self.merges.items():
            if both not in left or rank < left[both][0]:
                left[both] = (rank, a)
        beyond: dict[int, int] = {}
        longest = 0
        for (a, b), _ in sorted(self.merges.items(), key=lambda m: -m[1][0]):
            length = self.size[a] + beyond.get(a, 0)
            longest = max(longest, length)
            edge = b
            while True:  # every token at the left edge of b
                if beyond.get(edge, 0) < length:
                    beyond[edge] = length
                if edge not in left:
                    break
                edge = left[edge][1]
        return longest

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges on a list of symbols: lowest rank first, leftmost first among equals."""
        n = len(symbols)
        merges = self.merges
        if n < 2:
            return symbols
        if n < 64:
            # the merge of each neighbouring pair, as one sortable pair; none sorts last
            own, none = list(symbols), (1 << 60, 0)
            pairs = [merges.get(p, none) for p in zip(own, own[1:])]
            while pairs and (best := min(pairs)) is not none:
                i = pairs.index(best)
                own[i:i + 2] = [best[1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = merges.get((own[i], own[i + 1]), none)
                if i:
                    pairs[i - 1] = merges.get((own[i - 1], own[i]), none)
            return own
        own = list(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, own[i], own[i + 1]) for i in range(n - 1) if (m := merges.get((own[i], own[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = following[i]
            if own[i] != a or j >= n or own[j] != b:
                continue
            own[i], own[j] = merges[a, b][1], -1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
                if m := merges.get((own[i], own[after])):
                    heapq.heappush(queue, (m[0], i, own[i], own[after]))
            if (p := before[i]) >= 0 and (m := merges.get((own[p], own[i]))):
                heapq.heappush(queue, (m[0], p, own[p], own[i]))
        return [s for s in own if s != -1]


class Transducer:
    """Tokens of one word, fed in parts of any size. Holds at most `reach + block` symbols and the part just fed."""

    def __init__(self, merges: MergeList, block: int = BLOCK):
        self.merges, self.block = merges, block
        self.held: list[int] = []
        self.pending: int | None = None  # the last byte, which may yet turn out to end the word

    def feed(self, data: bytes) -> Iterator[int]:
        """Emit the tokens that no further byte can change."""
        for at in range(0, len(data), self.block):
            for byte in data[at:at + self.block]:
                if self.pending is not None:
                    self.held.append(self.merges.inner[self.pending])
                self.pending = byte
            if len(self.held) >= self.merges.reach + self.block:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        tokens, end, out = self.merges.apply(self.held), 0, 0
        bound = len(self.held) - self.merges.reach
        for t in tokens:
            end += self.merges.size[t]
            if end > bound:
                break
            out = end
            yield t
        self.held = self.held[out:]

    def finish(self) -> list[int]:
        """The tokens left when the word ends here."""
        if self.pending is None:
            return []
        tokens = self.merges.apply([*self.held, self.merges.last[self.pending]])
        self.held, self.pending = [], None
        return tokens


@lru_cache(maxsize=1)
def _letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


def _bytes_of(letters: str) -> bytes:
    byte = _letter_bytes()
    return bytes([byte[c] for c in letters])


class Decoder:
    """Text of a stream of ids, emitted as it becomes known.

    `spaced` writes each token as the vocabulary spells it, one space between two, as a tokenizer file without a
    decoder does. Otherwise the bytes behind the tokens become text: a character is emitted with its last
    byte, bytes that are no UTF-8 become U+FFFD, and a word end becomes a space.
    """

    def __init__(self, merges: MergeList, spaced: bool = False):
        self.tokens, self.end, self.specials = merges.tokens, merges.end, merges.special_ids
        self.spaced, self.first = spaced, True
        self.text = None if spaced else codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids complete; an id outside the vocabulary adds nothing."""
        known = [i for i in ids if i in self.tokens]
        if self.spaced:
            out = ("" if self.first or not known else " ") + " ".join([self.tokens[i] for i in known])
            self.first &= not known
            return out
        out = []
        for i in known:
            token = self.tokens[i]
            if i in self.specials:
                out.append(self._close() + token)
                continue
            ends = token.endswith(self.end)
            out.append(self.text.decode(_bytes_of(token[:-len(self.end)] if ends else token)))
            if ends:
                out.append(self._close() + " ")
        return "".join(out)

    def _close(self) -> str:
        """What is left of an unfinished character."""
        rest = self.text.decode(b"", True)
        self.text.reset()
        return rest

    def finish(self) -> str:
        return "" if self.spaced else self._close()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LISTS: dict[str, MergeList] = {}


def merge_list(path: str) -> MergeList:
    """The merge list at `path`, read once per worker."""
    path = os.fspath(path)
    if path not in _LISTS:
        _LISTS[path] = MergeList(path)
    return _LISTS[path]
