"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

The words form a trie whose edges are a distributed table `(parent, letter, child)`, a node being the prefix
it stands for. A search state is (position in the word, node, edits); words that share a prefix are in
the same state until they part, so the state of a word at a position is kept once per prefix, as the pair
(prefix of the word, node). Level by level the frontier is joined with the edge table: both sides go on by an equal letter,
and the one edit is spent by two letters under one node (replaced) or by a letter of the word alone
(deleted; an insertion is the same pair seen from the other word). States that end in two
words with one edit are neighbours.

No state list of one node grows with the data: a prefix has at most one child per letter, and the prefixes one
edit away from it are bounded by its length and the alphabet. So no join key is hot, however many words share
a prefix, and no pair is made that is not one edit apart so far. Words longer than `LEVELS` would need a round
per letter; they are joined by hashes of all their one-gap forms, each group of which holds at most
one word per letter, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scratch
from ..operators.joins import lookup

#: Fixed value: what a run of letters is.
RUNS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words up to this length go through the trie, a round of joins per letter.
LEVELS = 24


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """`(word, n)`: words of at least `shortest` code points that occur `least` times in all texts.

    A word is a run of letters with A-Z lower-cased. Where `every` divides crc32 of `<doc_id>:<run>`, one code point is
    missing, at that hash modulo the length. A null text has no words; a null id is written as `null`.
    Repeated rows count each; counts are summed where the words are before they travel.
    """
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(
        F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUNS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    dropped = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    word = F.when(F.col("h") % every == 0, dropped).otherwise(F.col("run"))
    return (run.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= shortest)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


def edges(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """`(parent, letter, child, depth, ends)`: the trie of words of at most `levels` letters; `ends` tells whether the child is a word."""
    step = F.explode(F.sequence(F.lit(1), F.length("word")))
    return (words.filter(F.length("word") <= levels).select("word", step.alias("depth"))
            .select(F.expr("substring(word, 1, depth)").alias("child"), "depth", (F.length("word") == F.col("depth")).alias("ends"))
            .groupBy("child").agg(F.first("depth").alias("depth"), F.max("ends").alias("ends"))
            .select(F.expr("substring(child, 1, depth - 1)").alias("parent"), F.expr("substring(child, depth)").alias("letter"),
                    "child", "depth", "ends"))


def _starts(trie: DataFrame) -> DataFrame:
    """States in which the edit was just spent: `(mine, other, depth, mine_ends, other_ends)`, `depth` the length of `mine`.

    Under one node two letters are exchanged (in one order, as both words see it), or one letter of `mine` is left out.
    """
    one = trie.select("parent", F.col("letter").alias("l1"), F.col("child").alias("mine"), "depth", F.col("ends").alias("mine_ends"))
    two = trie.select("parent", F.col("letter").alias("l2"), F.col("child").alias("other"), F.col("ends").alias("other_ends"))
    replaced = one.join(two, "parent").filter("l1 < l2").select("mine", "other", "depth", "mine_ends", "other_ends")
    above = trie.select(F.col("child").alias("other"), F.col("ends").alias("other_ends"))
    deleted = one.withColumnRenamed("parent", "other").join(above, "other", "left").select(
        "mine", "other", "depth", "mine_ends", F.coalesce("other_ends", F.lit(False)).alias("other_ends"))
    return replaced.unionByName(deleted)


def near_words(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """`(a, b)`: all pairs of `words` (distinct, column word) one edit apart, each once and in no certain order within."""
    trie, found = scratch.write_table(edges(words, levels), F.max("depth").alias("deepest"))
    starts, _ = scratch.write_table(_starts(trie))
    done = [starts.filter("mine_ends AND other_ends").select("mine", "other")]
    front = None
    for level in range(1, found["deepest"] or 0):
        fresh = starts.filter(F.col("depth") == level).drop("depth")
        front = fresh if front is None else front.unionByName(fresh)
        mine = trie.filter(F.col("depth") == level + 1).select(
            F.col("parent").alias("mine"), "letter", F.col("child").alias("mine_next"), F.col("ends").alias("mine_ends"))
        # a deletion leaves the other side one level behind
        other = trie.filter(F.col("depth").isin(level, level + 1)).select(
            F.col("parent").alias("other"), "letter", F.col("child").alias("other_next"), F.col("ends").alias("other_ends"))
        step = (front.drop("mine_ends", "other_ends").join(mine, "mine").join(other, ["other", "letter"])
                .select(F.col("mine_next").alias("mine"), F.col("other_next").alias("other"), "mine_ends", "other_ends"))
        front, _ = scratch.write_table(step)
        done.append(front.filter("mine_ends AND other_ends").select("mine", "other"))
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.unionByName(more)
    # one pair may be met on several ways, as either of two equal letters may be the one left out
    short = pairs.select(F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).distinct()
    return short.unionByName(_long_pairs(words, levels))


def gap_hashes(word: str) -> np.ndarray:
    """One 64-bit hash per gap form of a word (a letter exchanged for a hole) and per form with a letter left out, and the word's own."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)]))
        before = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:n])])
        after = before[n] - before[1:]  # what follows each letter, at its own place
        own = before[n] + power[n] * np.uint64(7)
        holes = before[:n] + after + power[n] * np.uint64(5)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        without = before[:n] + after * inverse + power[n - 1] * np.uint64(7)
    return np.concatenate([[own], holes, np.unique(without)]).view(np.int64)


def _long_pairs(words: DataFrame, levels: int) -> DataFrame:
    """Pairs of words one edit apart of which one at least is longer than `levels`."""
    @F.arrow_udf("array<struct<kind:int,key:bigint>>")
    def forms(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for w in part.to_pylist():
                h = gap_hashes(w)
                kinds = np.zeros(len(h), np.int32)
                kinds[0], kinds[1:len(w) + 1], kinds[len(w) + 1:] = 0, 1, 2
                out.append([{"kind": int(k), "key": int(v)} for k, v in zip(kinds, h)])
            yield pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64())])))

    long = words.filter(F.length("word") >= levels).select("word").select("word", F.explode(forms("word")).alias("f"))
    long = scratch.cut(long.select("word", "f.kind", "f.key"))
    holes = long.filter("kind = 1")
    exchanged = holes.withColumnRenamed("word", "a").join(holes.withColumnRenamed("word", "b"), "key").filter("a < b").select("a", "b")
    left_out = (long.filter("kind = 2").withColumnRenamed("word", "a").join(
        long.filter("kind = 0").withColumnRenamed("word", "b"), "key").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return exchanged.unionByName(left_out).filter((F.greatest(F.length("a"), F.length("b")) > levels) & _one_edit()).distinct()


def _one_edit() -> Column:
    return F.levenshtein("a", "b", 1) == 1


def spelling_groups(docs: DataFrame, levels: int = LEVELS, **settings) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` of every word of `word_counts(docs, **settings)`.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least twice its own,
    else null. Counts at least double along forms, so they end; the root is found by doubling, as many rounds as the
    logarithm of the longest chain. Only `doc_id` and `text` are read. Empty tables give no rows.
    """
    words = scratch.cut(word_counts(docs.select("doc_id", "text"), **settings))
    pairs = scratch.cut(near_words(words, levels))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.withColumnRenamed("word", "b"), "b")
    # the largest n first, then the smallest word: text orders by code points
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("b"))).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("fits", -F.col("best.less") >= 2 * F.col("n"))
    table = scratch.cut(chosen.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("fits"), F.col("best.b")).alias("form"),
        F.when(F.col("fits"), -F.col("best.less")).alias("form_n")))
    return table.join(roots(table), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(table: DataFrame) -> DataFrame:
    """`(word, root)` of every word with a form: where its chain of forms ends."""
    ahead, seen = scratch.write_table(table.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while seen["rows"]:
        further = lookup(ahead, F.col("root"), ahead, "word", {"beyond": "root"})
        ahead, info = scratch.write_table(
            further.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
            F.count_if("moved").alias("moved"))
        ahead = ahead.drop("moved")
        if not info["moved"]:
            break
    return ahead
