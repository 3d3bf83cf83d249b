"""Quality by nearest-neighbour voting in a latent semantic space.

A text is counted as hashed words, as trigrams of character classes (which show tables, signs and
shouting) and as how often its words and word pairs recur. Counts are damped, weighted by inverse
document frequency and projected on the leading singular vectors of a bounded labelled sample. The
sample's vectors are broadcast; each document takes exact cosine products with all of them, block by
block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .samples import id_remainder, labelled

#: Labelled documents of each class at most (about): the bound of what is fitted and broadcast.
PER_CLASS = {0: 2000, 1: 2000}
WORDS, SHAPES, REPEATS = 2048, 2048, 16
DIM = WORDS + SHAPES + 2 * REPEATS
LATENT = 48
NEIGHBOURS = 15
#: Documents compared at once.
BLOCK = 512


@dataclass
class Latent:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float


def _shape_classes() -> np.ndarray:
    """A small class for each code point: lower, upper, digit, blank, line feed, or the sign itself."""
    kind = np.full(0x110000, 1, dtype=np.uint32)
    for c in range(0x3000):
        s = chr(c)
        kind[c] = (1 if s.isalpha() and not s.isupper() else 2 if s.isupper() else 3 if s.isdigit() else 5 if s == "\n"
                   else 4 if s.isspace() else 7 + c)
    return kind


_SHAPES: list[np.ndarray] = []


def _repeats(doc: np.ndarray, key: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, how many of its keys occur 1, 2, 4, 8 ... times in it."""
    out = np.zeros((n_docs, REPEATS), np.float32)
    if len(key):
        # the text in the upper bits, so that one sort groups by text and key
        both = np.sort(doc.astype(np.uint64) << np.uint64(40) | key >> np.uint64(24))
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        times = np.diff(np.append(new, len(both)))
        level = np.minimum(np.log2(times).astype(np.int64), REPEATS - 1)
        of = (both[new] >> np.uint64(40)).astype(np.int64)
        out += np.bincount(of * REPEATS + level, weights=times, minlength=n_docs * REPEATS).reshape(n_docs, REPEATS)
    return out


def counts(texts: list[str]) -> np.ndarray:
    """Hashed counts of each text."""
    if not _SHAPES:
        _SHAPES.append(_shape_classes())
    w = words.split(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    h = words.word_hash(w)
    out[:, :WORDS] = np.bincount(w.doc * WORDS + words.fold(h, 11, 5), minlength=len(texts) * WORDS).reshape(-1, WORDS)
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    kind = _SHAPES[0][raw]
    size = np.diff(np.append(w.base, len(raw)))
    doc = np.repeat(np.arange(len(texts)), size)
    if len(raw) > 2:
        # a trigram belongs to a text if it doesn't reach beyond the line feed that ends it
        tri = ((kind[:-2] * np.uint32(1315423911) + kind[1:-1]) * np.uint32(2654435761) + kind[2:]) * np.uint32(0x9E3779B1)
        tri >>= np.uint32(21)
        at = (doc[:-2] * SHAPES + tri)[doc[:-2] == doc[2:]]
        out[:, WORDS:WORDS + SHAPES] = np.bincount(at, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
    out[:, WORDS + SHAPES:WORDS + SHAPES + REPEATS] = _repeats(w.doc, h, len(texts))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
    same = w.doc[:-1] == w.doc[1:]
    out[:, WORDS + SHAPES + REPEATS:] = _repeats(w.doc[:-1][same], pair[same], len(texts))
    return out


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped shares of a text's own words or signs, weighted, at unit length; no words give zeros."""
    y = np.sqrt(x / np.maximum(x[:, :WORDS].sum(axis=1, keepdims=True), 1)) * idf
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def train(rows: list[tuple[str, int]], prior: float) -> Latent:
    """Fit on `(text, label)` rows; `prior` is the share of label 1 among all training labels."""
    x = np.concatenate([counts(texts) for _, texts in words.batches([t for t, _ in rows])])
    labels = np.array([y for _, y in rows], dtype=np.float64)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
    y = _weighted(x, idf)
    # randomised subspace iteration for the leading right singular vectors
    basis = np.random.default_rng(1).standard_normal((DIM, LATENT + 16)).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(y.T @ (y @ basis))[0]
    rotate = np.linalg.svd(y @ basis, full_matrices=False)[2]
    basis = (basis @ rotate.T)[:, :LATENT]
    share = labels.mean()
    weights = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    return Latent(idf, basis, _latent(y, basis), labels, weights, prior)


def _latent(y: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = y @ basis
    return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vote(model: Latent, z: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest neighbours, each weighted by its similarity and its class's sampling."""
    out = np.empty(len(z))
    k = min(NEIGHBOURS, len(model.vectors))
    for i in range(0, len(z), BLOCK):
        cos = z[i:i + BLOCK] @ model.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        sim = np.maximum(np.take_along_axis(cos, near, axis=1).astype(np.float64), 0) ** 4 * model.weights[near]
        total = sim.sum(axis=1)
        out[i:i + BLOCK] = np.where(total > 0, (sim * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), model.prior)
    return out


def score_texts(model: Latent | None, prior: float, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), prior)
    out = [vote(model, _latent(_weighted(counts(batch), model.idf), model.basis)) for _, batch in words.batches(texts)]
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> tuple[Latent | None, float]:
    """The model and the share of label 1, from the training rows among `labels`."""
    share = labels.filter(id_remainder(F.col("doc_id"), 5) != 0).select(F.avg(F.col("quality").cast("double"))).first()[0]
    rows = labelled(docs, labels, "quality", per_class)
    if share is None or len({y for _, y in rows}) < 2:
        return None, float(share if share is not None else 0.5)
    return train(rows, share), float(share)


def with_quality(docs: DataFrame, model: Latent | None, prior: float, name: str = "quality_score") -> DataFrame:
    """Add `name`, the score of `text`: 0 to 1, higher for label 1.

    A null or empty text has no vector and scores the share of label 1, as every text does without
    training rows of both classes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, prior))

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted, share = shared.value
        for part in parts:
            yield pa.array(score_texts(fitted, share, part.to_pylist()), pa.float64())

    return docs.withColumn(name, score.asNondeterministic()(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row of `docs`; only `doc_id` and `text` are read."""
    model, prior = fit_quality(docs, labels)
    scored = with_quality(docs.select("doc_id", "text"), model, prior)
    return scored.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                         F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= cut, 1).otherwise(0).alias("predicted"))
