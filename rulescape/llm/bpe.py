"""Byte-pair encoding and decoding of whole texts with a word-end vocabulary.

A text is read in slices. Each slice is normalised (canonical composition, white space, lower case) and cut
into words; a word goes through the bounded-lookahead transducer of `transducer`, which emits a token once
nothing that follows can change it, so neither a long text nor a long word is ever held as tokens.
For digests, words and runs between white space are looked up in tables of those met lately, bounded in size.

Encoding is a map over rows: nothing is shuffled, and no group of rows is gathered.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transducer import Decoder, Transducer, default_tokenizer, merge_list

#: Code points of a text that are normalised and cut at a time.
SLICE = 1 << 15
#: A longer word is fed on slice by slice.
WORD = 64
#: Words, and runs between white space, that a worker keeps at most.
KNOWN = 300_000

#: Fixed value: contractions that the tokenizer takes as words of their own.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: What Python takes for white space and the tokenizer does not.
_CONTROLS = regex.compile(r"[\x1c-\x1f]")
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Code points that may compose with, or be ordered before, the one on their left."""
    pairs = {chr(int(d.split()[1], 16)) for c in range(0x110000)
             if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    jamo = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(pairs | jamo | {chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))})


def _slices(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """`(slice, words may run on)`: cuts before white space if there is any, else where normal forms do not meet."""
    at = 0
    while len(text) - at > size:
        end = at + size
        cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
        runs_on = cut < 0
        if runs_on:
            cut = end
            if not text[cut - 1:cut + 1].isascii():
                while cut < len(text) and text[cut] in _joining():
                    cut += 1
        yield text[at:cut], runs_on and cut < len(text)
        at = cut
    yield text[at:], False


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """For each code point: is it unknown to this Python's Unicode."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), dtype=bool, count=0x110000)


def _unknown(text: str) -> set[str]:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return {chr(c) for c in np.unique(codes[_unassigned()[codes]]).tolist()}


class Words:
    """Normal form and words of text, as the tokenizer file at `path` sees them.

    The Unicode of Python, of the patterns and of the library may differ in age: code points that Python does not know
    are put to the library itself, one by one as they occur, and slices with them normalised by it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.met: dict[str, str] = {}
        self._compile()

    def _compile(self) -> None:
        met = {kind: regex.escape("".join(c for c, k in self.met.items() if k == kind)) for kind in "LNS"}
        space = r"\p{White_Space}"
        other = {kind: "".join(met[k] for k in "LNS" if k != kind) for kind in "LN"}
        letters, numbers = (rf"[[\p{{{k}}}{met[k]}]--[{other[k]}\uffff]]" for k in "LN")
        self.letters = regex.compile(f"{letters}+", regex.V1)
        self.signs = regex.compile(f"[^{space}{letters}{numbers}]+", regex.V1)
        self.words = regex.compile(f"{CONTRACTIONS}|{self.letters.pattern}|{numbers}|{self.signs.pattern}", regex.V1)

    def normal(self, text: str) -> str:
        """Canonical composition and lower case, code point by code point."""
        if text.isascii():
            return text.lower()
        if found := _unknown(text):
            text = self.library.normalizer.normalize_str(text)
            new = (found | _unknown(text)) - self.met.keys()
            for c in new:
                # the words of a letter, this one and a sign tell its class
                cuts = [b - a for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}!")]
                kind = {(2, 1): "L", (1, 1, 1): "N"}.get(tuple(cuts), "S")
                # only those matter that the patterns see otherwise
                self.met[c] = "" if kind == ("L" if _LETTER.match(c) else "N" if _NUMBER.match(c) else "S") else kind
            if any(self.met[c] for c in new):
                self._compile()
            return text
        # a final sigma is lowered as any other
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    """Ids of texts under one merge list, as a stream of parts; `Digester` gives digests of the same stream."""

    def __init__(self, path: str, size: int = SLICE, known: int = KNOWN):
        self.merges, self.words, self.size, self.known = merge_list(path), Words(path), size, known
        names = sorted(self.merges.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def word(self, word: str) -> list[int]:
        """Ids of one whole word."""
        machine = Transducer(self.merges)
        return [*machine.feed(word.encode()), *machine.finish()]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a run without white space, normalised."""
        return [i for w in self.words.words.findall(chunk) for i in self.word(w)]

    def parts(self, text: str | None) -> Iterator[list[str] | tuple[int, ...]]:
        """A text in order, as lists of whole runs between white space (`chunk` encodes one) and ids of long runs; null has none.

        The strings of special tokens become their ids, wherever they stand.
        """
        text = text or ""
        if self.special is None or not self.special.search(text):
            yield from self._plain(text)
            return
        for i, piece in enumerate(self.special.split(text)):
            if i % 2:
                yield (self.merges.specials[piece],)
            elif piece:
                yield from self._plain(piece)

    def _plain(self, text: str) -> Iterator[list[str] | tuple[int, ...]]:
        stream: Iterator | None = None
        for part, runs_on in _slices(text, self.size):
            part = self.words.normal(part)
            if stream is None and not runs_on and not _CONTROLS.search(part):
                yield part.split()
                continue
            # a run that reaches over the end of the slice, or white space of two kinds
            stream = stream or _LongRuns(self)
            yield from stream.feed(part, runs_on)
            if not runs_on:
                stream = None

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            if isinstance(part, tuple):
                out.extend(part)
            else:
                for chunk in part:
                    out.extend(self.chunk(chunk))
        return out


class _LongRuns:
    """Ids of slices whose last word may run on into the next slice. Holds a short word or the state of a long one."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.words = encoder, encoder.words
        self.carried = ""
        self.machine: Transducer | None = None
        self.kind = "letters"

    def feed(self, part: str, runs_on: bool) -> Iterator[tuple[int, ...]]:
        part = self.carried + part
        self.carried, at = "", 0
        if self.machine is not None:
            if more := getattr(self.words, self.kind).match(part):
                yield tuple(self.machine.feed(more.group().encode()))
                at = more.end()
            if at == len(part) and runs_on:
                return
            yield tuple(self.machine.finish())
            self.machine = None
        words, last = self.words.words.findall(part, at), ""
        if runs_on and words and part.endswith(words[-1]):
            last = words.pop()
            # an apostrophe before may yet be that of a contraction
            if words and words[-1] == "'" and part.endswith("'" + last) and len(last) <= WORD:
                last = words.pop() + last
        for w in words:
            machine = Transducer(self.encoder.merges)
            yield tuple(machine.feed(w.encode()))
            yield tuple(machine.finish())
        if len(last) > WORD:
            self.machine, self.kind = Transducer(self.encoder.merges), "letters" if self.words.letters.match(last) else "signs"
            yield tuple(self.machine.feed(last.encode()))
        else:
            self.carried = last


class _Recent:
    """What `make` returns for keys met lately. Holds at most `known` keys and those of one call more."""

    def __init__(self, make: Callable[[str], tuple[str, str]], known: int):
        self.make, self.half = make, known // 2
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def all(self, keys: list[str]) -> list[tuple[str, str]]:
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for k in set(keys):
            if k not in young:
                young[k] = old.get(k) or self.make(k)
        return list(map(young.__getitem__, keys))


class Digester:
    """Digests of a text's ids and of their decoded text, without holding either."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.words = _Recent(lambda w: self._texts(encoder.word(w)), encoder.known)
        self.chunks = _Recent(self._chunk, encoder.known // 4)

    def _texts(self, ids: Iterable[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), Decoder(self.encoder.merges, spaced=True).feed(ids)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        return _joined(self.words.all(self.encoder.words.words.findall(chunk)))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """`(tokens, sha256 of the ids, sha256 of the decoded text)`."""
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        for part in self.encoder.parts(text):
            ids, decoded = self._texts(part) if isinstance(part, tuple) else _joined(self.chunks.all(part))
            if ids:
                gap = " " if n else ""
                ids_hash.update((gap + ids).encode())
                text_hash.update((gap + decoded).encode())
                n += ids.count(" ") + 1
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _joined(found: list[tuple[str, str]]) -> tuple[str, str]:
    """Both texts of all, but of those without ids (a run may have no word)."""
    return " ".join([f[0] for f in found if f[0]]), " ".join([f[1] for f in found if f[0]])


_ENCODERS: dict[str, Encoder] = {}
_DIGESTERS: dict[str, Digester] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _digester(path: str) -> Digester:
    if path not in _DIGESTERS:
        _DIGESTERS[path] = Digester(_encoder(path))
    return _DIGESTERS[path]


def _free(docs: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in docs.columns}
    for name in names:
        if name.lower() in taken:
            raise ValueError(f"the result column {name} is a column of the input; choose another name")


def encode(docs: DataFrame, column: str = "ids", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """All columns of `docs` and `column`, an array of the ids of `text`; null or empty text has no ids.

    Rows are independent, so repeats and their order do not matter. The name must be new, whatever its case.
    """
    _free(docs, column)
    path = tokenizer or default_tokenizer()

    @F.arrow_udf("array<int>")
    def ids_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for part in parts:
            yield pa.array((encoder.encode(t.as_py()) for t in part), pa.list_(pa.int32()))

    return docs.withColumn(column, ids_of(F.col(f"`{text}`")))


def decode(rows: DataFrame, column: str = "decoded", ids: str = "ids", tokenizer: str | None = None, spaced: bool = False) -> DataFrame:
    """All columns of `rows` and `column`, the text of `ids`; null or no ids give the empty text, null or unknown ids nothing.

    Lower case, white space and composed characters are not undone. `spaced` spells tokens as the vocabulary does.
    """
    _free(rows, column)
    path = tokenizer or default_tokenizer()

    @F.arrow_udf("string")
    def text_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = []
            for value in part:
                machine = Decoder(merge_list(path), spaced)
                texts.append(machine.feed(value.as_py() or []) + machine.finish())
            yield pa.array(texts, pa.string())

    return rows.withColumn(column, text_of(F.col(f"`{ids}`")))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)` of every text; null counts as empty. Repeated rows give equal rows."""
    path = tokenizer or default_tokenizer()

    @F.arrow_udf(_DIGEST)
    def digests_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digester = _digester(path)
        for part in parts:
            rows = [digester.digest(t.as_py()) for t in part]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))],
                names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests_of("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
