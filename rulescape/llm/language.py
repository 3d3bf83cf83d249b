"""Language of words and documents by a linear-chain conditional random field.

The states are the languages of the training rows. A word's features are its affixes, its letter
trigrams and its entry in a lexicon of words that the sample shows in one language; transitions
are learned. Forward-backward marginals label each word, so text that switches language is
followed word by word; a document's language is the one with the largest mean marginal.

The field always names a learned language, so it cannot say that a text has none of them. That is
judged by letter trigrams: a text whose trigrams the sample hardly shows is not `learned`.
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
from .samples import fitted, id_remainder, rate_of, thinned

BITS = 17
#: Training documents of all languages together at most (about); the bound of the sample.
SAMPLE = 2000
#: A word enters the lexicon of a language with so many sightings, nearly all of them there.
SIGHTINGS = 4
PURITY = 0.9
UNKNOWN = "und"
#: Trigrams of the sample are kept in a table of 2**SEEN bits.
SEEN = 22
#: A text is not learned if its shares of known words and of known letters both lie below these
#: parts of what nearly all training documents reach without their own trigrams.
LEAST_WORDS = 0.6
LEAST_LETTERS = 0.8
#: So many training documents of each language may lie lower (mislabelled, junk).
ODD = 0.01


def _lexicon(parts, labels: list[np.ndarray], states: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and the language each belongs to."""
    keys, inverse = np.unique(np.concatenate([words.word_hash(w) for w in parts]), return_inverse=True)
    seen = np.bincount(inverse * states + np.concatenate(labels), minlength=len(keys) * states).reshape(-1, states)
    total, best = seen.sum(axis=1), seen.argmax(axis=1)
    keep = (total >= SIGHTINGS) & (seen.max(axis=1) >= PURITY * total)
    return keys[keep], best[keep]


def _features(w: words.Words, lexicon: tuple[np.ndarray, np.ndarray], states: int) -> Features:
    keys, languages = lexicon
    h = words.word_hash(w)
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
    # the first weights are the lexicon's: one per language, and one for words it lacks
    entry = np.where(known, languages[at], states) if len(keys) else np.full(len(h), states)
    affixes = words.affix_hashes(w, (1, 2, 3), BITS) + words.affix_hashes(w, (1, 2, 3), BITS, suffix=True)
    return Features([entry.astype(np.int64), *affixes], words.trigrams(w, BITS), w.end - w.start)


def _shares(w: words.Words, known: np.ndarray) -> np.ndarray:
    """Per text: the share of words whose trigrams are all known, and of letters whose trigram is; `known` is per letter.

    Letters that touch a digit are of a key or number, not of a word, and do not count.
    """
    size = w.end - w.start
    out = np.zeros((w.n_docs, 2))
    if not len(size):
        return out
    digit = (w.codes >= 48) & (w.codes <= 57)
    plain = ~(digit[w.end] | (digit[w.start - 1] & (w.start > 0)))
    whole = np.logical_and.reduceat(known, np.cumsum(size) - size) & plain
    in_plain, letter_doc = np.repeat(plain, size), np.repeat(w.doc, size)
    for i, (doc, good, counted) in enumerate(((w.doc, whole, plain), (letter_doc, known & in_plain, in_plain))):
        total = np.bincount(doc, weights=counted, minlength=w.n_docs)
        out[:, i] = np.bincount(doc, weights=good, minlength=w.n_docs) / np.maximum(1, total)
    return out


def _evidence(parts, labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of the sample as a table, and the least shares of words and letters of a learned text.

    A training document's own shares count only trigrams that another one has too. The bound comes
    from the language with the lowest shares, so that a rare one is not lost.
    """
    docs_with = np.zeros(1 << SEEN, np.int32)
    for w in parts:
        pair = np.unique(np.repeat(w.doc, w.end - w.start).astype(np.int64) << SEEN | words.trigrams(w, SEEN))
        np.add.at(docs_with, pair & ((1 << SEEN) - 1), 1)
    shares, of = [np.zeros((0, 2))], [np.zeros(0, np.int64)]
    for w, y in zip(parts, labels):
        with_words, at = np.unique(w.doc, return_index=True)
        shares.append(_shares(w, docs_with[words.trigrams(w, SEEN)] > 1)[with_words])
        of.append(y[at])
    shares, of = np.concatenate(shares), np.concatenate(of)
    low = [np.quantile(shares[of == s], ODD, axis=0, method="lower") for s in np.unique(of)]
    least = np.min(low, axis=0) if low else np.zeros(2)
    return docs_with > 0, least * (LEAST_WORDS, LEAST_LETTERS)


@dataclass
class _Batches:
    """Minibatches of training words. Their features are many times larger than the texts, so they are made anew each epoch."""
    parts: list[words.Words]
    labels: list[np.ndarray]
    lexicon: tuple[np.ndarray, np.ndarray]
    states: int

    def __iter__(self):
        for w, y in zip(self.parts, self.labels):
            yield _features(w, self.lexicon, self.states), *words.chains(w, LONGEST), y, np.ones(len(y))


def train(rows: list[tuple[str, str]]) -> Crf | None:
    """Fit on `(text, language)` rows; every word of a document is labelled with its language."""
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    parts, labels, n = [], [], 0
    for _, texts in words.batches([t for t, _ in rows], 1 << 18):
        w = words.split(texts)
        of = np.array([names.index(lang) for _, lang in rows[n:n + len(texts)]], dtype=np.int64)
        parts.append(w)
        labels.append(of[w.doc])
        n += len(texts)
    lexicon = _lexicon(parts, labels, len(names))
    model = fit(_Batches(parts, labels, lexicon, len(names)), BITS, len(names), epochs=3)
    seen, least = _evidence(parts, labels)
    model.extra.update(names=names, lexicon=lexicon, seen=seen, least=least)
    return model


def _marginals(model: Crf, w: words.Words) -> np.ndarray:
    first, size = words.chains(w, LONGEST)
    return model.marginals(_features(w, model.extra["lexicon"], len(model.extra["names"])), first, size)


def label_words(model: Crf, text: str) -> list[tuple[int, int, str, float]]:
    """`(start, end, language, marginal)` of every word of one text."""
    w = words.split([text])
    gamma = _marginals(model, w)
    best = gamma.argmax(axis=1)
    return [(int(s), int(e), model.extra["names"][b], float(g[b])) for s, e, b, g in zip(w.start, w.end, best, gamma)]


def score_texts(model: Crf | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Per text: language, its mean marginal over all letters, and the share of words of other languages."""
    return _scored(model, texts)[:3]


def _scored(model: Crf | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
    """As `score_texts`, and whether the text is of a learned language."""
    langs: list[str] = []
    scores: list[float] = []
    switched: list[float] = []
    learned: list[bool] = []
    for _, batch in words.batches(texts):
        w = words.split(batch)
        if model is None or not len(w.start):
            langs += [UNKNOWN] * len(batch)
            scores += [0.0] * len(batch)
            switched += [0.0] * len(batch)
            learned += [False] * len(batch)
            continue
        gamma = _marginals(model, w).astype(np.float64)
        length = (w.end - w.start).astype(np.float64)
        k = gamma.shape[1]
        mass = np.stack([np.bincount(w.doc, weights=gamma[:, s] * length, minlength=w.n_docs) for s in range(k)], axis=1)
        letters, n_words = mass.sum(axis=1), np.bincount(w.doc, minlength=w.n_docs)
        best = mass.argmax(axis=1)
        other = np.bincount(w.doc, weights=gamma.argmax(axis=1) != best[w.doc], minlength=w.n_docs)
        enough = (_shares(w, model.extra["seen"][words.trigrams(w, SEEN)]) >= model.extra["least"]).any(axis=1)
        for d in range(w.n_docs):
            some = letters[d] > 0
            langs.append(model.extra["names"][best[d]] if some else UNKNOWN)
            scores.append(float(min(1.0, mass[d, best[d]] / letters[d])) if some else 0.0)
            switched.append(float(other[d] / n_words[d]) if some else 0.0)
            learned.append(bool(some and enough[d]))
    return langs, scores, switched, learned


def fit_language(docs: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """The model from documents with a language whose id does not leave remainder 1 of 3."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    usable = usable.select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().count()
    if not counts:
        return None
    rates = rate_of(usable.select("lang"), "lang", max(1, sample // counts))
    found = thinned(usable, "lang", rates).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"))
    return fitted(found, lambda rows: train([(r["text"], r["lang"]) for r in rows]))


def with_language(docs: DataFrame, model: Crf | None, name: str = "language") -> DataFrame:
    """Add `name`: struct of language, score, the share of words in other languages and `learned`, from `text` alone.

    A text that is null or has no letter gets `und` and score 0, as every text does when no
    training row has a language; none of these is learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,switched:double,learned:boolean>")
    def tag(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            langs, scores, switched, learned = _scored(shared.value, part.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switched, pa.float64()),
                                              pa.array(learned, pa.bool_())], names=["lang", "score", "switched", "learned"])

    return docs.withColumn(name, tag.asNondeterministic()(F.col("text")))


def language_predictions(docs: DataFrame) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score, switched)` of every row; a null id is not held out."""
    tagged = with_language(docs.select("doc_id", "text"), fit_language(docs))
    return tagged.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                         F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
                         F.col("language.switched").alias("switched"))
