"""Near-duplicate documents by DartMinHash over shingles of five words.

A document is a weighted set: its shingles, each weighing as often as it occurs. Over every element
lies the plane of weight and rank, on which hashed darts fall at unit density, the same for every
document. A document owns the darts under its weights; each dart belongs to one of K coordinates,
and the earliest dart of each coordinate is the signature. Two documents agree in a coordinate with
the probability of their weighted Jaccard similarity, and a document throws about K ln K darts
whatever its length.

Signatures are joined by bands. Equal texts are folded first, and a bucket is never paired with
itself: in a few turns each member is compared with two centres of its bucket, the links found make
components. What is left of different components is compared by its differences from what most of its
neighbours have in common (`_missed`): a family of texts with edits of their own is thus not paired.
Every alike pair in a bucket is in one component or is found there. Candidates are verified exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.scratch import cut, write_table
from .names import free
from . import words

SHINGLE = 5
THRESHOLD = 0.8
#: Coordinates of a signature, in bands: a pair at the threshold shares no band once in 10**7.
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: Darts per document and pass: all coordinates are hit in most cases, else more are thrown.
DARTS = math.ceil(K * math.log(K) + 2 * K)
#: Coordinates (of two bits each) that a pair at the threshold shares but once in 10**9.
AGREE = math.floor(K * (0.25 + 0.75 * THRESHOLD) - 6 * math.sqrt(K * (0.25 + 0.75 * THRESHOLD) * 0.75 * (1 - THRESHOLD)))

#: Turns in which buckets are compared with two centres each. They only save work: large groups become few components
#: before the members of different components are compared.
TURNS = 4

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Signatures `[n_docs, K]` of weighted sets given as `(doc, element, weight)`; each has an element."""
    # a weight is a pile of slabs of height one; the top slab may be filled in part
    slabs = np.ceil(weight).astype(np.int64)
    level = np.arange(slabs.sum()) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    key = _mix(np.repeat(element, slabs) + level.astype(np.uint64) * _GOLD)
    owner = np.repeat(doc, slabs)
    filled = np.minimum(np.repeat(weight, slabs) - level, 1.0)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    theta = DARTS / np.maximum(total, 1e-300)
    best = np.full((n_docs, K), np.inf)
    name = np.zeros((n_docs, K), np.uint64)
    todo = np.arange(len(key))
    while len(todo):
        at, rank, n = todo, np.zeros(len(todo)), 0
        hits = []
        while len(at):
            # ranks over one slab are a Poisson process: gaps are exponential
            h = _mix(key[at] + np.uint64((2 * n + 1) * 0x5851F42D4C957F2D % (1 << 64)))
            rank = rank - np.log(_unit(h))
            early = rank < theta[owner[at]]
            at, rank, h = at[early], rank[early], h[early]
            dart = _mix(h ^ _GOLD)
            own = filled[at] >= 1.0
            own |= _unit(_mix(dart + _GOLD)) < filled[at]
            hits.append((owner[at[own]], rank[own], dart[own]))
            n += 1
        of = np.concatenate([x[0] for x in hits])
        rank = np.concatenate([x[1] for x in hits])
        dart = np.concatenate([x[2] for x in hits])
        cell = of * K + (dart % np.uint64(K)).astype(np.int64)
        flat, ids = best.ravel(), name.ravel()
        np.minimum.at(flat, cell, rank)
        first = flat[cell] == rank
        ids[cell[first]] = dart[first]
        best, name = flat.reshape(n_docs, K), ids.reshape(n_docs, K)
        open_docs = ~np.isfinite(best).all(axis=1) & (total > 0)
        theta[open_docs] *= 2
        todo = np.flatnonzero(open_docs[owner])
    return name


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(doc, element, count)` of all texts, ordered by text.

    A text of fewer than five words has one shingle, all its words; one without a word is its own
    only element, so it is like equal texts and no other.
    """
    w = words.split(texts, digits=True)
    h = words.word_hash(w)
    n_words = np.bincount(w.doc, minlength=len(texts))
    full = np.flatnonzero(w.doc[:-SHINGLE + 1] == w.doc[SHINGLE - 1:]) if len(h) >= SHINGLE else np.zeros(0, np.int64)
    gram = np.zeros(len(full), np.uint64)
    for j in range(SHINGLE):
        gram = _mix(gram * _GOLD + h[full + j])
    doc, element = [w.doc[full]], [gram]
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero(n_words < SHINGLE)
    odd = []
    for d in short.tolist():
        if n_words[d]:
            raw = h[first[d]:first[d] + n_words[d]].tobytes()
        else:
            raw = b"\0" + texts[d].encode()
        odd.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))
    doc.append(short)
    element.append(np.array(odd, dtype=np.uint64))
    doc, element = np.concatenate(doc), np.concatenate(element)
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], element[new], np.diff(np.append(new, len(doc)))


def members(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Each weighted set as 64-bit numbers: one per element and occurrence, so that sets compare as multisets."""
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = _mix(np.repeat(element, count) + level.astype(np.uint64) * _GOLD).view(np.int64)
    size = np.bincount(doc, weights=count, minlength=n_docs).astype(np.int64)
    return np.split(key, np.cumsum(size)[:-1]) if n_docs else []


_SIGNED = "struct<size:bigint,sketch:array<bigint>,bands:array<bigint>>"


def _sign(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        n, size, sketch, bands = len(part), [], [], []
        for _, texts in words.batches(part.to_pylist()):
            doc, element, count = shingles(texts)
            name = dart_minhash(doc, element, count.astype(np.float64), len(texts))
            size.append(np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64))
            # two bits of each coordinate, 32 coordinates in a long
            two = (_mix(name) & np.uint64(3)).reshape(len(texts), K // 32, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
            sketch.append(np.bitwise_or.reduce(two, axis=2).view(np.int64))
            band = np.zeros((len(texts), BANDS), np.uint64)
            for r in range(ROWS):
                band = _mix(band * _GOLD + name[:, r::ROWS])
            bands.append(_mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64))

        def lists(rows, width):
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat))

        yield pa.StructArray.from_arrays(
            [pa.array(np.concatenate(size) if size else np.zeros(0, np.int64)),
             lists(sketch, K // 32), lists(bands, BANDS)], names=["size", "sketch", "bands"])


def _members_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        out = []
        for _, texts in words.batches(part.to_pylist()):
            out += [np.unique(m) for m in members(*shingles(texts), len(texts))]
        ends = np.cumsum([0] + [len(m) for m in out]).astype(np.int32)
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _likely(a: str, b: str):
    """Sizes and sketches of two rows allow a similarity of the threshold."""
    same = F.lit(0)
    for i in range(K // 32):
        x = F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])
        apart = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        same = same + 32 - F.bit_count(apart)
    sizes = F.least(F.col(f"{a}.size"), F.col(f"{b}.size")) >= THRESHOLD * F.greatest(F.col(f"{a}.size"), F.col(f"{b}.size")) - 1e-9
    return sizes & (same >= AGREE)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of `pairs`, by nodes `a, b`, whose weighted Jaccard similarity, by whole sets, reaches the threshold."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= THRESHOLD * (F.size("x") + F.size("y") - shared) - 1e-9).drop("x", "y")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """`(node, members)` of the wanted nodes, from the text of each node's first document."""
    read = F.arrow_udf("array<bigint>")(_members_of)
    some = nodes.join(wanted, "node").select("node", "doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _node(F.coalesce("text", F.lit(""))).alias("own"))
    rows = texts.join(some, (texts.doc_id.eqNullSafe(some.doc_id)) & (texts.own == some.node)).select("node", "text")
    return cut(rows.select("node", read.asNondeterministic()(F.col("text")).alias("members")).dropDuplicates(["node"]))


def _node(text):
    """Digest of a text."""
    return F.unhex(F.md5(text))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    mixed = placed.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("two")).filter("one < two").select("band")
    return cut(placed.join(mixed, "band"))


def _reachable(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of nodes that may be like another node of `placed`.

    A set shares no more than the members that another set here has as well, which bounds its
    similarity: a text with many edits of its own reaches nobody.
    """
    here = placed.select("node").distinct()
    each = sets.join(here, "node", "left_semi").select("node", F.size("members").alias("size"), F.explode("members").alias("member"))
    alone = (each.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("x")).filter("n = 1")
             .groupBy("x.node").agg(F.count(F.lit(1)).alias("own"), F.min("x.size").alias("size")))
    far = alone.filter(F.col("size") - F.col("own") < THRESHOLD * F.col("size") - 1e-9)
    return placed.join(far.select("node"), "node", "left_anti")


#: Share of both sizes that alike sets have in common at least.
_PART = THRESHOLD / (1 + THRESHOLD)


def _prefix_pairs(tokens: DataFrame, nodes: DataFrame, wanted: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of nodes of different components that may share as many tokens of `(group, token, node)` as `wanted` says.

    `nodes` are `(node, root, size, d, w, base, edge, least)`: a pair matters if one of it is an `edge`, and then
    shares `least` tokens of either node. Ordered by rarity, the first tokens of both then have one in common, and
    both must hold enough tokens from there on.
    """
    times = tokens.groupBy("group", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(tokens.join(times, ["group", "token"]))
    counts = shared.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    able = nodes.join(counts, "node").filter(F.col("k") >= F.col("least"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "token"))
    first = shared.join(able.drop("group"), "node").withColumn("at", place).filter(F.col("at") <= F.col("k") - F.col("least") + 1)
    first = cut(first.select("group", "token", "node", "root", "size", "d", "w", "base", "edge", (F.col("k") - F.col("at") + 1).alias("left")))
    mixed = first.groupBy("group", "token").agg(F.min("root").alias("one"), F.max("root").alias("two")).filter("one < two")
    first = cut(first.join(mixed.select("group", "token"), ["group", "token"]))
    p, q = first.alias("p"), first.alias("q")
    sizes = F.least("p.size", "q.size") >= THRESHOLD * F.greatest("p.size", "q.size") - 1e-9
    enough = F.least("p.left", "q.left") >= wanted("p", "q") - 1e-9
    same = (F.col("p.group") == F.col("q.group")) & (F.col("p.token") == F.col("q.token"))
    found = p.join(q, same & (F.col("p.root") < F.col("q.root")) & (F.col("p.edge") | F.col("q.edge")) & sizes & enough)
    return found.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.root").alias("ra"), F.col("q.root").alias("rb"))


def _missed(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates `(a, b, ra, rb)` among nodes that share buckets and are of different components.

    Nodes joined by buckets are a group, and its base c is what more than half of them have. With D the members of c
    that a set lacks and A those it has beyond c, two sets share |c| - |D1 + D2| + |A1 & A2|, so alike ones have
        |D1 & D2| + |A1 & A2| >= w1 + w2 - |c|,  w = part * size + |D|.
    If w1 + w2 <= |c|, a pair is alike without more, and so is each of it with the node of least w: a star of it joins
    them. Other pairs need |A1 & A2| >= max(|D1|, |D2|) + part * (size1 + size2) - |c|. Where that is
    above zero they share a member outside the base, which few have, and are found by prefixes of such members.
    Where it need not be, for nodes near the base but no part of the star, prefixes of D and A find them.
    """
    names = placed.groupBy("band").agg(F.min("node").alias("b"))
    links = cut(placed.join(names, "band").select(F.col("node").alias("a"), "b").distinct())
    groups = components(links).select(F.col("name").alias("node"), F.col("root").alias("group"))
    of = cut(placed.select("node", "root").distinct().join(groups, "node")
             .join(sets.select("node", F.size("members").alias("size")), "node"))
    held = cut(of.select("node", "group").join(sets, "node").select("group", "node", F.explode("members").alias("token")))
    total = of.groupBy("group").agg(F.count(F.lit(1)).alias("total"))
    often = held.groupBy("group", "token").agg(F.count(F.lit(1)).alias("n")).join(total, "group")
    base = cut(often.filter(2 * F.col("n") > F.col("total")).select("group", "token"))
    sizes = base.groupBy("group").agg(F.count(F.lit(1)).alias("base"))
    kept = held.join(base, ["group", "token"], "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("kept"))
    facts = (of.join(sizes, "group", "left").join(kept, "node", "left").withColumn("base", F.coalesce("base", F.lit(0)))
             .withColumn("d", F.col("base") - F.coalesce("kept", F.lit(0))).drop("kept")
             .withColumn("w", _PART * F.col("size") + F.col("d")))
    facts = cut(facts)
    ends = facts.groupBy("group").agg(F.min("size").alias("s0"), F.min_by(F.struct("node", "root", "w"), F.struct("w", "node")).alias("m"))
    facts = cut(facts.join(ends, "group"))
    star = (facts.filter((F.col("w") + F.col("m.w") <= F.col("base") + 1e-9) & (F.col("root") != F.col("m.root")))
            .select(F.col("node").alias("a"), F.col("m.node").alias("b"), F.col("root").alias("ra"), F.col("m.root").alias("rb")))

    other = held.join(base, ["group", "token"], "left_anti")
    partner = F.greatest(F.col("s0").cast("double"), THRESHOLD * F.col("size"))
    least = F.ceil(F.col("d") + _PART * (F.col("size") + partner) - F.col("base") - 1e-9)
    outside = facts.withColumn("edge", F.lit(True)).withColumn("least", F.greatest(least, F.lit(1)))
    pairs = star.unionByName(_prefix_pairs(other, outside, lambda p, q: F.greatest(f"{p}.d", f"{q}.d")
                                           + _PART * (F.col(f"{p}.size") + F.col(f"{q}.size")) - F.col(f"{p}.base")))

    def near(smallest: str) -> Column:
        return F.col("w") + _PART * F.col(smallest) <= F.col("base") + 1e-9

    inner = facts.filter(near("s0"))
    inner = inner.join(inner.groupBy("group").agg(F.min("size").alias("s1")), "group").filter(near("s1"))
    inner = inner.withColumn("edge", F.col("w") + F.col("m.w") > F.col("base") + 1e-9)
    edges = inner.groupBy("group").agg(F.min(F.when(F.col("edge"), F.col("w"))).alias("e0")).filter("e0 is not null")
    inner, seen = write_table(inner.join(edges, "group"))
    if not seen["rows"]:
        return pairs
    lacking = (inner.select("group", "node").join(base, "group").select("group", "token", "node")
               .join(held, ["group", "token", "node"], "left_anti"))
    beyond = other.join(inner.select("node"), "node", "left_semi").select("group", "token", "node")
    least = F.ceil(F.col("w") + F.when(F.col("edge"), F.col("m.w")).otherwise(F.col("e0")) - F.col("base") - 1e-9)
    inner = inner.withColumn("least", F.greatest(least, F.lit(1)))
    return pairs.unionByName(_prefix_pairs(lacking.unionByName(beyond), inner,
                                           lambda p, q: F.col(f"{p}.w") + F.col(f"{q}.w") - F.col(f"{p}.base")))


def _merged(links: DataFrame) -> DataFrame:
    """`(root, top)`: components of components, from links that carry the components of both ends."""
    return cut(components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
               .select(F.col("name").alias("root"), F.col("root").alias("top")))


def _relabelled(rows: DataFrame, upper: DataFrame) -> DataFrame:
    return rows.join(upper, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`(doc_id, node, class_id, keeper)` for every row of `docs`, which has `doc_id, text`.

    Texts whose weighted Jaccard similarity over shingles of five words is 0.8 or more are linked,
    and linked texts are one class. `class_id` is the smallest `doc_id` of the class, `node` a digest
    of the row's text, `keeper` whether the row has the class's first `doc_id` and its text. Words are runs
    of letters or digits, in lower case. Null is an empty text; equal texts, also empty ones, are of
    one class. No rows give no rows; a null id is the class's only if no other is there.
    """
    text = F.coalesce("text", F.lit(""))
    sign = F.arrow_udf(_SIGNED)(_sign)
    signed = cut(docs.select("doc_id", _node(text).alias("node"), sign.asNondeterministic()(text).alias("s")).select("doc_id", "node", "s.*"))
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"),
                                           F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")))
    rows = nodes.select(F.explode("bands").alias("band"), "node")
    crowds = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    known = nodes.select("node", F.struct("node", "size", "sketch").alias("me"))
    placed = cut(rows.join(crowds, "band").join(known, "node").select("band", "node", "me", F.col("node").alias("root")))
    sets = _sets(docs, nodes, placed.select("node").distinct())
    labels = nodes.select("node", F.col("doc_id").alias("first"), F.col("node").alias("root"))
    for turn in range(TURNS):
        # every turn other centres: what is near none of them yet may be near the next ones
        placed = _mixed(placed)
        order = F.xxhash64("node", F.lit(turn))
        centre = F.struct("me", "root")
        centres = placed.groupBy("band").agg(F.min_by(centre, order).alias("low"), F.max_by(centre, order).alias("high"))
        near = placed.join(centres, "band").select("me", "root", F.explode(F.array("low", "high")).alias("centre"))
        near = near.filter((F.col("root") != F.col("centre.root")) & _likely("me", "centre.me"))
        pairs = near.select(F.col("me.node").alias("a"), F.col("centre.me.node").alias("b"), F.col("root").alias("ra"), F.col("centre.root").alias("rb"))
        upper = _merged(_verified(cut(pairs.distinct()), sets))
        placed, labels = _relabelled(placed, upper), _relabelled(labels, upper)
    # what may yet be alike, shares a bucket and is not in one component by now
    pairs = _missed(_mixed(cut(_reachable(_mixed(placed), sets))), sets)
    classes = _relabelled(labels, _merged(_verified(cut(pairs.distinct()), sets))).withColumnRenamed("root", "class")
    classes = cut(classes)
    keepers = classes.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("late"), "first", "node")).alias("k"))
    known = classes.join(keepers, "class").select("node", F.col("k.first").alias("class_id"), F.col("k.node").alias("keeper_node"))
    out = signed.select("doc_id", "node").join(known, "node")
    return out.select("doc_id", "node", "class_id",
                      (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper_node"))).alias("keeper"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one of each class, with all columns of `docs`, whatever their names."""
    own_id, own_node, times, digest = free(docs, "_id", "_node", "_times", "_own")
    marked = cut(near_duplicates(docs.select("doc_id", "text")).filter("keeper").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias(times)))
    marked = marked.withColumnsRenamed({"doc_id": own_id, "node": own_node})
    rows = docs.withColumn(digest, _node(F.coalesce("text", F.lit(""))))
    stay = rows.join(marked, rows["doc_id"].eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(own_node)))
    once, often = stay.filter(F.col(times) == 1), stay.filter(F.col(times) > 1)
    return once.unionByName(often.dropDuplicates([own_id, own_node])).select(*[F.col(f"`{c}`") for c in docs.columns])
