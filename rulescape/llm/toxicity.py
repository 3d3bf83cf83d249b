"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document. A first pass over the training sample finds the words and affixes
that toxic documents share and others lack; in a toxic document the words that carry them are the
labelled tokens. The field learns to tag these, its forward-backward marginals are the tokens'
probabilities, and a logistic fit turns a document's marginals into its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .crf import LONGEST, Crf, Features, fit
from .samples import fitted, id_remainder, sampled

BITS = 18
#: Training documents of each class at most (about); the bound of the sample.
PER_CLASS = {0: 2500, 1: 1500}
#: A shared feature must separate the classes at least so well (log-likelihood ratio): this much, and
#: this much per toxic document of the sample.
EVIDENCE = 16.0
EVIDENCE_PER_DOC = 0.03

_RESULT = "struct<score:double,n_spans:int,spans:array<struct<start:int,end:int,marginal:double>>>"


def _features(w: words.Words) -> Features:
    """Hashed word, prefixes and suffixes of each word, and a constant."""
    whole = words.fold(words.word_hash(w), BITS, 1)
    return Features([whole, *words.affix_hashes(w, (4, 5, 6), BITS), *words.affix_hashes(w, (4,), BITS, suffix=True),
                     np.zeros(len(whole), np.int64)])


def _llr(a: np.ndarray, n1: int, c: np.ndarray, n0: int) -> np.ndarray:
    """Signed log-likelihood ratio of seeing a feature in `a` of n1 toxic and `c` of n0 other documents."""
    def term(k, n, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (n - k) * np.log(1 - p)
    p1, p0, p = a / max(n1, 1), c / max(n0, 1), (a + c) / max(n1 + n0, 1)
    g = 2 * (term(a, n1, p1) + term(c, n0, p0) - term(a, n1, p) - term(c, n0, p))
    return np.where(p1 > p0, g, 0.0)


def _copies(w: words.Words) -> np.ndarray:
    """A sketch of each text, its least hash of two adjacent words: copies mostly share it."""
    h = words.word_hash(w)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
    out = np.arange(w.n_docs, dtype=np.uint64)
    inside = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    if len(inside):
        first = np.flatnonzero(np.diff(w.doc[inside], prepend=-1))
        out[w.doc[inside[first]]] = np.minimum.reduceat(pair[inside], first)
    return out


@dataclass
class Part:
    """What training keeps of a batch of texts: a fraction of the texts' own size."""
    features: Features
    first: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    sketch: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, texts: list[str], label: list[int]) -> "Part":
        w = words.split(texts)
        f = _features(w)
        f.single = [x.astype(np.int32) for x in f.single]
        first, size = words.chains(w, LONGEST)
        return cls(f, first, size, w.doc.astype(np.int32), _copies(w), np.array(label, dtype=np.int64))


def _token_evidence(parts: list[Part]) -> list[np.ndarray]:
    """For each word of each part, the best evidence among its own features (not the constant).

    Documents are counted by their sketch, so a large group of copies counts about once.
    """
    sketches, group = np.unique(np.concatenate([p.sketch for p in parts]), return_inverse=True)
    y = np.zeros(len(sketches), dtype=np.int64)
    np.maximum.at(y, group, np.concatenate([p.label for p in parts]))
    ends = np.cumsum([0] + [len(p.label) for p in parts])
    seen = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    kinds = len(parts[0].features.single) - 1
    for kind in range(kinds):
        pairs = [np.unique(group[at:][p.doc].astype(np.int64) << BITS | p.features.single[kind]) for p, at in zip(parts, ends)]
        pair = np.unique(np.concatenate(pairs))
        label = y[pair >> BITS]
        for k in (0, 1):
            seen[k] += np.bincount(pair[label == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    g = _llr(seen[1], int(y.sum()), seen[0], int((1 - y).sum()))
    return [np.max([g[idx] for idx in p.features.single[:kinds]], axis=0) if p.features.n else np.zeros(0) for p in parts]


def _summaries(gamma: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: largest marginal, its noisy-or, and the expected number of toxic words (log)."""
    p = gamma[:, 1].astype(np.float64)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc, p)
    some = 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_docs))
    return np.stack([top, some, np.log1p(np.bincount(doc, weights=p, minlength=n_docs)), np.ones(n_docs)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(rows: list[tuple[str, int]], prior: float) -> Crf:
    """Fit tagger and score on `(text, toxic)` rows; `prior` is the share of toxic among all labelled rows."""
    parts = [Part.of(texts, [y for _, y in rows[at:at + len(texts)]])
             for at, texts in words.batches([t for t, _ in rows], 1 << 18)]
    least = max(EVIDENCE, EVIDENCE_PER_DOC * sum(int(p.label.sum()) for p in parts))
    batches = []
    for p, g in zip(parts, _token_evidence(parts)):
        best = np.zeros(len(p.label))
        np.maximum.at(best, p.doc, g)
        # the words that explain the label of their document, not every word that came along
        tag = (p.label[p.doc] == 1) & (g >= least) & (g >= 0.3 * best[p.doc])
        batches.append((p.features, p.first, p.size, tag.astype(np.int8), np.where(tag, 5.0, 1.0).astype(np.float32)))
    # one batch in four is kept from the tagger, so that the score is fitted on marginals it has not seen
    tagged = [b for i, b in enumerate(batches) if i % 4 or len(batches) < 4]
    scored = [p for i, p in enumerate(parts) if i % 4 == 0 or len(parts) < 4]
    model = fit(tagged, BITS, 2, epochs=6)
    x = np.concatenate([_summaries(model.marginals(p.features, p.first, p.size), p.doc, len(p.label)) for p in scored])
    y = np.concatenate([p.label for p in scored]).astype(float)
    share = y.mean()
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    model.extra["beta"] = _logistic(x, y, weight)
    return model


def _spans(w: words.Words, p: np.ndarray, n_docs: int) -> list[list[dict]]:
    """Runs of words tagged toxic in one text: code-point offsets and the largest marginal."""
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    hit = np.flatnonzero(p >= 0.5)
    last = -2
    for i in hit.tolist():
        d = int(w.doc[i])
        start, end = int(w.start[i] - w.base[d]), int(w.end[i] - w.base[d])
        if i == last + 1 and out[d]:
            out[d][-1]["end"] = end
            out[d][-1]["marginal"] = max(out[d][-1]["marginal"], float(p[i]))
        else:
            out[d].append({"start": start, "end": end, "marginal": float(p[i])})
        last = i
    return out


def score_texts(model: Crf | None, prior: float, texts: list[str | None]) -> list[dict]:
    out = []
    for _, batch in words.batches(texts):
        if model is None:
            out += [{"score": prior, "n_spans": 0, "spans": []}] * len(batch)
            continue
        w = words.split(batch)
        first, size = words.chains(w, LONGEST)
        gamma = model.marginals(_features(w), first, size)
        score = 1 / (1 + np.exp(-_summaries(gamma, w.doc, w.n_docs) @ model.extra["beta"]))
        spans = _spans(w, gamma[:, 1], w.n_docs)
        out += [{"score": float(s), "n_spans": len(x), "spans": x} for s, x in zip(score, spans)]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> tuple[Crf | None, float]:
    """The model and the share of toxic labels, from the training rows among `labels`."""
    train_rows = labels.filter(id_remainder(F.col("doc_id"), 5) != 0)
    share = train_rows.select(F.avg(F.col("toxic").cast("double"))).first()[0]
    if share is None:
        return None, 0.0

    def tagger(rows: list[dict]) -> Crf | None:
        found = [(r["text"], r["label"]) for r in rows]
        return train(found, share) if len({y for _, y in found}) == 2 else None

    return fitted(sampled(docs, labels, "toxic", per_class), tagger), float(share)


def with_toxicity(docs: DataFrame, model: Crf | None, prior: float, name: str = "toxicity") -> DataFrame:
    """Add `name`: struct of score, number of toxic spans and the spans (code-point offsets) of `text`.

    A null or empty text, or one without a word, scores by the fitted constant and has no span.
    Without training rows of both classes every text scores the share of toxic labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, prior))

    @F.arrow_udf(_RESULT)
    def tag(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted, share = shared.value
        kind = pa.struct([("score", pa.float64()), ("n_spans", pa.int32()),
                          ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))])
        for part in parts:
            yield pa.array(score_texts(fitted, share, part.to_pylist()), type=kind)

    return docs.withColumn(name, tag.asNondeterministic()(F.col("text")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, held_out, score, predicted, n_spans, spans)` of every row of `docs`.

    Only `doc_id` and `text` of `docs` are read. A null id is not held out and has no label.
    """
    model, prior = fit_toxicity(docs, labels)
    tagged = with_toxicity(docs.select("doc_id", "text"), model, prior)
    return tagged.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                         F.col("toxicity.score").alias("score"),
                         F.when(F.col("toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"),
                         F.col("toxicity.n_spans").alias("n_spans"), F.col("toxicity.spans").alias("spans"))
