"""Training sequences by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest as
fit, then one for each bit of the rest. A piece is a sequence of its own, so no sequence crosses a
document and none needs padding, and pieces of equal length form a bucket. Packing is a map over
documents: nothing is shuffled, and no bucket or document group is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .names import free
from .tokens import Encoder

LONGEST = 1024
#: Ends every document.
END = 0

_PIECES = "array<struct<start:bigint,length:bigint,doc_tokens:bigint,ids_crc32:bigint,ids:array<int>>>"
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to `n`, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces_of(encoder: Encoder, texts: list[str | None], with_ids: bool):
    """For each text its pieces, as `(start, length, doc_tokens, crc32, ids)`."""
    for _, batch in words.batches(texts):
        ids, counts = encoder.encode(batch)
        at = 0
        for n in counts.tolist():
            doc = np.append(ids[at:at + n], np.uint32(END)).astype("<u4")
            at += n
            raw, out, start = doc.tobytes(), [], 0
            for length in binary_lengths(n + 1):
                crc = zlib.crc32(raw[4 * start:4 * (start + length)])
                out.append((start, length, n + 1, crc, doc[start:start + length] if with_ids else None))
                start += length
            yield out


def sequences(encoder: Encoder, part: pa.Array, with_ids: bool) -> Iterator[pa.Array]:
    """The pieces of the texts in `part`, as a few arrays one after the other: one holds the ids of `words.TEXTS` texts at
    most, and of `words.CHARS` code points or one text, however many rows come in a batch."""
    for at in range(0, len(part), words.TEXTS):
        for _, texts in words.batches(part.slice(at, words.TEXTS).to_pylist()):
            docs_of = list(pieces_of(encoder, texts, with_ids))
            rows = [p for doc in docs_of for p in doc]
            start, length, total, crc = (pa.array([r[i] for r in rows], pa.int64()) for i in range(4))
            if with_ids:
                size = np.array([0] + [r[1] for r in rows], np.int64)
                flat = np.concatenate([r[4] for r in rows]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(flat))
            else:
                ids = pa.nulls(len(rows), pa.list_(pa.int32()))
            piece = pa.StructArray.from_arrays([start, length, total, crc, ids], names=["start", "length", "doc_tokens", "ids_crc32", "ids"])
            ends = np.cumsum([0] + [len(d) for d in docs_of]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), piece)


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """The columns of `docs` but its text, and one row per piece.

    Added: `start, length, doc_tokens, ids_crc32, sequence_id, offset, bucket`, and `ids` unless
    `with_ids` is false. `docs` has `text`; a null or empty text is the end token alone. A column of
    `docs` with the name of an added one, in any case, is dropped. Each row of `docs`, repeated or not, is packed
    by itself. `sequence_id` is unique and, for the same files, the same in every run and retry.
    """
    path = tokenizer or default_tokenizer()

    @F.arrow_udf(_PIECES)
    def cut_up(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for part in parts:
            yield from sequences(encoder, part, with_ids)

    added = {"start", "length", "doc_tokens", "ids_crc32", "ids", "sequence_id", "offset", "bucket"}
    kept = [c for c in docs.columns if c != "text" and c.lower() not in added]
    pieces, piece = free(docs, "_pieces", "_piece")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], "text").withColumn(pieces, cut_up.asNondeterministic()(F.col("text")))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.explode(pieces).alias(piece))
    taken = ["start", "length", "doc_tokens", "ids_crc32"]
    out = rows.select(*[F.col(f"`{c}`") for c in kept], *[F.col(piece)[c].alias(c) for c in taken],
                      F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                      F.col(piece)["length"].alias("bucket"), *([F.col(piece)["ids"].alias("ids")] if with_ids else []))
    return out


def write_buckets(sequences: DataFrame, path: str) -> None:
    """One folder per length, so that a reader draws batches of equal sequences."""
    sequences.write.partitionBy("bucket").parquet(path)
