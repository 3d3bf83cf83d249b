"""Document fingerprints by spot signatures, with DataFrame operations only.

Common words are anchors. The chain of content words that follows an anchor is a signature, so that
running prose leaves many of them and menus, tables and noise few. A fingerprint is the set of a
text's signatures; two are compared by Jaccard similarity, and a pair whose set lengths already
rule out the bound is pruned before its sets are touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.scratch import cut

#: Anchors: common words of English, German, French and Spanish.
ANCHORS = tuple(dict.fromkeys("""
the of and to a in is that it for was on with as be by this are at from or an not have has had were which but they his her
der die und in den von zu das mit sich im für des auf ist nicht dem ein als eine einer auch es an werden aus er hat dass sie nach
de la le et les des en un du que est une pour qui dans par au sur pas avec ne se ce il plus son sont aux mais ou
la que el en y los se del las un por con una no para su es al lo como más pero sus le ya o este sí porque
""".split()))
#: Content words in a chain.
CHAIN = 2
#: Hexadecimal digits of a signature's digest.
DIGITS = 8

#: Documents in a chunk of the order by id, intervals of ids and chunks in an interval.
CHUNK, INTERVALS, CHUNKS = 64, 256, 256


def _words(text: Column) -> Column:
    """The words in lower case, each after a space, common ones marked by `=`."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    marked = F.transform(plain, lambda w: F.when(w.isin(list(ANCHORS)), F.concat(F.lit("="), w)).otherwise(w))
    return F.concat(F.lit(" "), F.array_join(marked, " "))


def signatures(text: Column) -> Column:
    """Sorted digests of a text's spot signatures.

    A text without any signature has one digest, of itself, so that it is like its copies only;
    the empty text has none. Matching is possessive and each run of common words is read twice at
    most, so a text of any length takes linear time.
    """
    run, word = r"(?: =[^ ]++)", r" ([^= ][^ ]*+)"
    chain = word + "".join(rf"(?={run}*+{word})" if i == 0 else "" for i in range(CHAIN - 1))
    spots = F.split(F.regexp_replace(_words(text), rf"({run}++){chain}", "\n$1\t" + ":".join(f"${i + 2}" for i in range(CHAIN)) + "\n"), "\n")
    spots = F.filter(spots, lambda s: s.contains("\t"))
    chains = F.flatten(F.transform(spots, lambda s: F.transform(
        F.split(F.substring_index(s.substr(F.lit(3), F.length(s)), "\t", 1), " ="),
        lambda anchor: F.concat(anchor, F.lit(":"), F.substring_index(s, "\t", -1)))))
    digests = F.array_sort(F.array_distinct(F.transform(F.array_distinct(chains), lambda c: F.substring(F.md5(c), 1, DIGITS))))
    return (F.when(text == "", F.array().cast("array<string>"))
            .when(F.size(digests) > 0, digests).otherwise(F.array(F.substring(F.md5(text), 1, DIGITS))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints as arrays; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of `text` as an array of digests; null counts as empty."""
    return docs.withColumn(name, signatures(F.coalesce("text", F.lit(""))))


def near_copies(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`(doc_id, class_id)` of all rows of `(doc_id, fingerprint)`: classes of alike fingerprints.

    Equal fingerprints are folded. Sets are partitioned by length so that only neighbouring
    partitions can reach the threshold. In a partition, two sets that reach it share one of their
    rarest signatures; under each such signature every set is compared with the shortest, and then
    only sets of different classes are compared with each other. Empty fingerprints are one class.
    """
    folded = prints.select("doc_id", F.array_join("fingerprint", "").alias("node"), "fingerprint")
    nodes = cut(folded.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("fingerprint").alias("sigs"))
                .withColumn("n", F.size("sigs")))
    each = nodes.filter("n > 0").select("node", "n", F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    rarest = (each.join(common, "sig").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
              .select("node", "n", F.explode(F.slice("by_df", F.lit(1), keep.cast("int"))).alias("s")))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    placed = rarest.select("node", "n", F.col("s.sig").alias("sig"), F.explode(F.array(part, part + 1)).alias("part")).distinct()
    crowds = placed.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "node")).alias("low")).filter("m > 1")
    crowded = cut(placed.join(crowds, ["part", "sig"]).select("part", "sig", "n", "node", "low"))
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("sigs").alias("x")), "a")
                .join(nodes.select(F.col("node").alias("b"), F.col("sigs").alias("y")), "b"))
        return both.filter(likeness(F.col("x"), F.col("y")) >= threshold - 1e-12).drop("x", "y")

    stars = (crowded.filter((F.col("node") != F.col("low.node")) & fits(F.col("n"), F.col("low.n")))
             .select(F.col("node").alias("a"), F.col("low.node").alias("b")).distinct())
    roots = cut(components(cut(verified(stars))).withColumnsRenamed({"name": "node"}))
    labelled = cut(crowded.join(roots, "node", "left").select("part", "sig", "n", "node", F.coalesce("root", "node").alias("root")))
    mixed = labelled.groupBy("part", "sig").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q").select("part", "sig")
    split = labelled.join(mixed, ["part", "sig"])
    cross = (split.alias("p").join(split.alias("q"), (F.col("p.part") == F.col("q.part")) & (F.col("p.sig") == F.col("q.sig"))
                                   & (F.col("p.root") < F.col("q.root")) & fits(F.col("p.n"), F.col("q.n")))
             .select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.root").alias("ra"), F.col("q.root").alias("rb")).distinct())
    bridges = cut(verified(cross).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    upper = components(bridges).select(F.col("name").alias("root"), F.col("root").alias("top"))
    known = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(upper, "root", "left")
    known = cut(known.select("node", "first", F.coalesce("top", "root").alias("class")))
    least = known.groupBy("class").agg(F.min("first").alias("class_id"))
    return folded.select("doc_id", "node").join(known.join(least, "class").select("node", "class_id"), "node").select("doc_id", "class_id")


def _chunked(rows: DataFrame) -> DataFrame:
    """Add `chunk`: larger for larger ids, about `CHUNK` rows each at first, and never over 65,792 chunks.

    Intervals between quantiles of the ids are cut evenly, so gaps and clusters of ids do no harm.
    Rows without an id follow all others and are dealt by their digest.
    """
    quantiles = [i / INTERVALS for i in range(INTERVALS + 1)]
    seen = rows.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", quantiles, 4 * INTERVALS).alias("q")).first()
    unknown = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int") - 256
    bounds = sorted(set(seen.q or []))
    if not bounds:
        return rows.withColumn("chunk", unknown)
    tops = bounds[1:] or [bounds[0] + 1]
    per = min(CHUNKS, math.ceil(seen.n / len(tops) / CHUNK))
    widths = [max(1, -(-(hi - lo) // per)) for lo, hi in zip(bounds, tops)]
    k = F.size(F.filter(F.lit(tops[:-1]).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    at = lambda values: F.element_at(F.lit(values).cast("array<bigint>"), k + 1)
    inside = F.floor((F.col("doc_id").cast("double") - at(bounds[:len(tops)])) / at(widths))
    chunk = k * CHUNKS + F.greatest(F.lit(0), F.least(F.lit(CHUNKS - 1), inside)).cast("int")
    return rows.withColumn("chunk", F.when(F.col("doc_id").isNull(), unknown).otherwise(chunk))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Chunks of `docs` in the order of descending id, each followed by the first rows of the next.

    Returns the rows `(doc_id, text, digest, chunk, guest)` and the window that orders a chunk; the
    row after a row in it is the next document, and the first follows the last. Texts
    are shuffled once, by chunk; what is broadcast is one row per chunk.
    """
    rows = _chunked(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text")))
    heads = rows.groupBy("chunk").agg(F.max(F.struct("doc_id", "digest")).alias("head"))
    down = Window.orderBy(F.desc("chunk"))
    heads = heads.select(F.col("head.doc_id").alias("head_id"), F.col("head.digest").alias("head_digest"),
                         F.coalesce(F.lag("chunk").over(down), F.min("chunk").over(Window.partitionBy(F.lit(0)))).alias("before"))
    guests = rows.join(F.broadcast(heads), (F.col("digest") == F.col("head_digest")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    both = rows.withColumn("guest", F.lit(False)).unionByName(
        guests.select("doc_id", "text", "digest", F.col("before").alias("chunk"), F.lit(True).alias("guest")))
    order = Window.partitionBy("chunk").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("digest"))
    return both, order


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends with the start of the next document's, in the order of descending `doc_id`
    (equal ids by descending digest of the text, null ids last; after the last comes the first),
    in place of its last third. Null counts as empty. A single row is its own next. No rows give no rows.
    """
    rows, order = with_next(docs)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), size - third),
                                              F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), third)))
    rows = rows.select("doc_id", "digest", "chunk", "guest", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       signatures(F.col("text")).alias("own"), F.when(~F.col("guest"), signatures(F.col("edited"))).alias("changed"))
    rows = rows.withColumn("following", F.lead("own").over(order)).filter(~F.col("guest"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"),
                       F.array_join("changed", "").alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
