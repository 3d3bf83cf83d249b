"""Mix sources to target weights by capped water-filling.

Every source has a weight. A given multiple of all words is shared by weight; a source whose
share would exceed its maximum number of epochs is clamped there and the excess is shared among
the others, until no share is too large. A source then repeats each of its documents a whole
number of times and once more for a seeded part of them, so that the words taken meet the target.

Only DataFrame operations. Per-source sums are partial aggregates, so a source that holds a third
of all rows is never gathered. The seeded order of a source is cut into 4,096 slices by the first
digits of a hash; only the slice in which the target falls is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import cut

#: A word: anything between white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words to take: three halves of what there is.
SHARE = (3, 2)
MAX_EPOCHS = 2
#: Range partitions of the table of sources (one row per source).
RANGES = 32


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sources by code point, null last, as one text that is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _draw(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Add `before_<c>`: the sum of `c` over all rows that come earlier in a total order.

    The rows are range-partitioned and written, then numbered inside each range; only one
    row per range goes through a window without a partition.
    """
    parts = cut(df.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()))
    totals = parts.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
            .join(base, "_range")
            .select(*df.columns, *[(F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(f"before_{c}") for c in sums]))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`(key, source_size, weight, target)` of `(key, source_size)`, one row per source.

    Sources in order of `key` take the weights in turn. The clamped sources are those of least
    size per weight; sorted by that, one pass of running sums finds them exactly. Whole numbers
    up to the one division, so every engine gets the same doubles.
    """
    up, down = share
    if up > max_epochs * down:
        raise ValueError("more words asked for than the maximum epochs hold")
    wide = lambda c: c.cast("decimal(19,0)")
    spread = 1
    for w in weights:
        spread *= w
    counted = _running(sizes.withColumn("n", F.lit(1).cast("long")), ["key"], ["n"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.col("before_n") % len(weights) + 1).cast("int"))
    ranked = counted.withColumn("weight", weight).select(
        "key", "source_size", "weight", (F.col("source_size") * max_epochs).alias("cap"))
    # smallest cap per weight first: cap / weight, times the product of all weights, is whole
    ranked = ranked.withColumn("level", (wide(F.col("cap")) * F.floor(F.lit(spread) / F.col("weight")).cast("decimal(9,0)")))
    filled = cut(_running(ranked, ["level", "key"], ["cap", "weight"]))
    total = filled.select(F.sum("source_size")).scalar()
    all_weights = filled.select(F.sum("weight")).scalar()
    left = total * up - F.col("before_cap") * down
    rest = all_weights - F.col("before_weight")
    held = filled.withColumn("clamped", wide(F.col("cap")) * wide(rest * down) <= wide(left) * wide(F.col("weight")))
    held = cut(held)
    clamped_cap = held.select(F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))), F.lit(0))).scalar()
    free_weight = held.select(F.sum(F.when(~F.col("clamped"), F.col("weight")))).scalar()
    open_share = (total * up - clamped_cap * down) * F.col("weight") / (free_weight * down).cast("double")
    return held.select("key", "source_size", "weight",
                       F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(open_share).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"))


def _slices(sized: DataFrame, seed: int) -> DataFrame:
    """One row per source: target, whole repetitions, and where the part of a repetition ends.

    `cut_key` is the draw of the last document that is taken once more; of its `cut_words` words
    `part` are taken. Documents with a smaller draw are taken whole.
    """
    drawn = sized.withColumn("draw", _draw(F.col("doc_id"), seed))
    sliced = drawn.groupBy("key", F.substring("draw", 1, 3).alias("slice")).agg(F.sum("size").alias("words"))
    sliced = cut(sliced)
    targets = cut(source_targets(sliced.groupBy("key").agg(F.sum("words").alias("source_size"))))
    goal = F.floor("target").cast("long")
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    hit = (sliced.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
           .join(plan.select("key", "rest"), "key")
           .filter("before < rest AND rest <= before + words").select("key", "slice", "before", "rest"))
    # a document id that repeats within a source is one unit: its rows share the part
    units = (drawn.withColumn("slice", F.substring("draw", 1, 3)).join(hit, ["key", "slice"])
             .groupBy("key", "before", "rest", "draw").agg(F.sum("size").alias("cut_words")))
    inside = Window.partitionBy("key").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    ends = (units.withColumn("before", F.col("before") + F.coalesce(F.sum("cut_words").over(inside), F.lit(0)))
            .filter("before < rest AND rest <= before + cut_words")
            .select("key", F.col("draw").alias("cut_key"), "cut_words", (F.col("rest") - F.col("before")).alias("part")))
    return plan.select("key", "source_size", "weight", "target", "whole").join(ends, "key", "left")


def _part_of(size: Column) -> Column:
    """Words of a row of the unit at which the target is met."""
    return F.floor(size.cast("decimal(19,0)") * F.col("part").cast("decimal(19,0)")
                   / F.col("cut_words").cast("decimal(19,0)")).cast("long")


def mix_plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`(doc_id, size, source_size, target, taken)` for every row of `docs`.

    `docs` has `doc_id, text, source`; other columns are ignored. A null or empty text has size 0
    and takes nothing. A null source is a source of its own, after all others. Rows that repeat a
    `doc_id` within a source are drawn together. A source without words has target 0. No rows give
    no rows. `taken` never exceeds `MAX_EPOCHS * size`, and a source's sum is its target, rounded
    down (up to one word less per repeated row of one document).
    """
    sized = cut(_sized(docs))
    plan = cut(_slices(sized, seed))
    drawn = sized.withColumn("draw", _draw(F.col("doc_id"), seed)).join(plan, "key")
    extra = (F.when(F.col("cut_key").isNull() | (F.col("draw") > F.col("cut_key")), F.lit(0))
             .when(F.col("draw") < F.col("cut_key"), F.col("size")).otherwise(_part_of(F.col("size"))))
    return drawn.select("doc_id", "size", "source_size", "target",
                        (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with the columns of `docs`.

    The document at which a source's target is met contributes its leading words as a row of its
    own. A text without words costs nothing and is repeated like its neighbours in the draw.
    """
    sized = cut(_sized(docs))
    plan = cut(_slices(sized, seed))
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text, doc_id, source = (F.col(names[c]) for c in ("text", "doc_id", "source"))
    rows = (kept.withColumns({"key": _source_key(source), "draw": _draw(doc_id, seed)}).join(plan, "key"))
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.when((F.col("draw") == F.col("cut_key")), _part_of(word_count(text)))
    full = F.col("whole") + F.when(F.col("draw") < F.col("cut_key"), 1).otherwise(0)
    part_text = F.when(F.col("part_words") > 0, F.array_join(F.slice(words, F.lit(1), F.col("part_words").cast("int")), ""))
    rows = rows.withColumn("part_words", F.coalesce(part, F.lit(0)))
    copies = F.concat(F.array_repeat(text, full.cast("int")),
                      F.when(F.col("part_words") > 0, F.array(part_text)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("copy", F.explode(copies))
    return rows.select(*[(F.col("copy") if c == "text" else F.col(n)).alias(c) for c, n in names.items()])
