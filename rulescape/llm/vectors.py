"""Near-duplicate vectors by a pigeonhole join over subspaces.

Two unit vectors with cosine >= t lie within a squared distance of 2 - 2t. After a rotation the
coordinates are split into blocks; if every block were farther apart than its share of that
budget, the sum would exceed it, so a pair is near in at least one block. Each block is joined by
range: a grid over its first two coordinates, then a window over the third, then the distance in
the whole block. The union of the blocks' candidates is verified exactly, in double precision.

Equal vectors are folded into one before the join. A grid cell with many vectors is split into
pairs of salted slices, so no cell is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.scratch import cut

THRESHOLD = 0.98
BLOCK = 8
#: Vectors of one cell in one slice.
SLICE = 2048
_SEED = 20260


def rotation(dim: int) -> np.ndarray:
    """A seeded orthogonal matrix; it spreads energy evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[tuple[int, int]]:
    """Coordinate ranges of about `BLOCK` dimensions."""
    n = max(1, round(dim / BLOCK))
    edges = [round(i * dim / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def budget(first: int, last: int, dim: int, threshold: float) -> float:
    """Radius of a block: its proportion of the squared distance, with room for rounding."""
    return float(np.sqrt((2 - 2 * threshold) * (last - first) / dim) + 1e-6)


_PLACED = "rep long, label long, dim int, block int, cell_a long, cell_b long, home boolean, part array<float>"


def _placer(threshold: float):
    def place(batches):
        for batch in batches:
            reps = batch.column("rep").to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            vectors = batch.column("embedding")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.asarray(vectors.value_lengths())
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = np.stack([flat[starts[i]:starts[i + 1]] for i in rows])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(int(dim))
                for b, (first, last) in enumerate(blocks(int(dim))):
                    r = budget(first, last, int(dim), threshold)
                    part = x[:, first:last]
                    a = np.floor(part[:, 0] / r).astype(np.int64)
                    c = np.floor(part[:, 1] / r).astype(np.int64) if part.shape[1] > 1 else np.zeros(len(a), np.int64)
                    # its own cell, and the half of the neighbours that no other row covers
                    for da, dc in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)):
                        if dc and part.shape[1] == 1:
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reps[rows]), pa.array(labels[rows].astype(np.int64)),
                             pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), b, np.int32)),
                             pa.array(a + da), pa.array(c + dc), pa.array(np.full(len(rows), da == 0 and dc == 0)),
                             pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (last - first),
                                                      pa.array(part.astype(np.float32).ravel()))],
                            names=["rep", "label", "dim", "block", "cell_a", "cell_b", "home", "part"])
    return place


def _pairs_in_cell(threshold: float):
    """Pairs of one slice pair whose distance in the block is within its budget."""
    def search(table: pa.Table) -> pa.Table:
        dim, b = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        r = budget(*blocks(dim)[b], dim, threshold)
        part = table.column("part").combine_chunks()
        x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
        rep = table.column("rep").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        salt = table.column("salt").to_numpy()
        left_of = np.flatnonzero(home)
        window = x[:, 2 if x.shape[1] > 2 else 0]
        order = np.argsort(window, kind="stable")
        x, rep, home, salt, window = x[order], rep[order], home[order], salt[order], window[order]
        left_of = np.flatnonzero(home)
        out_a, out_b = [], []
        norms = (x * x).sum(1)
        for i in range(0, len(left_of), 256):
            l = left_of[i:i + 256]
            first = np.searchsorted(window, window[l[0]] - r, "left")
            last = np.searchsorted(window, window[l[-1]] + r, "right")
            d = norms[l][:, None] + norms[None, first:last] - 2 * x[l] @ x[first:last].T
            near = d <= r * r + 1e-6
            # each unordered pair of slices once; home pairs once, and guests only against home
            j = np.arange(first, last)
            near &= (salt[l][:, None] + salt[None, j]) == lo + hi
            near &= (salt[l][:, None] == lo) | (salt[l][:, None] == hi)
            near &= ~home[None, j] | (rep[l][:, None] < rep[None, j])
            p, q = np.nonzero(near)
            out_a.append(rep[l[p]])
            out_b.append(rep[j[q]])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b_ = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b_), "b": np.maximum(a, b_)})
    return search


def _verifier(threshold: float):
    def verify(batches):
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            size = np.asarray(u.value_lengths())
            x = u.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            y = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            if not len(size):
                continue
            big = np.repeat(np.maximum.reduceat(np.abs(x), at), size), np.repeat(np.maximum.reduceat(np.abs(y), at), size)
            x, y = x / big[0], y / big[1]
            dot, xx, yy = (np.add.reduceat(z, at) for z in (x * y, x * x, y * y))
            keep = dot / np.sqrt(xx * yy) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))],
                                             names=["a", "b"])
    return verify


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs `(a, b)` of `(rep, label, embedding)` that are near in at least one block."""
    placed = cut(reps.mapInArrow(_placer(threshold), _PLACED))
    cell = ["label", "dim", "block", "cell_a", "cell_b"]
    # a cell without a vector of its own has nothing to compare its guests with
    crowds = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("own"))
    crowds = (crowds.filter("own AND n > 1")
              .select(*cell, F.ceil(F.col("n") / SLICE).cast("int").alias("slices")))
    rows = placed.join(crowds, cell).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumns({"lo": F.least("salt", "other"), "hi": F.greatest("salt", "other")}).drop("other", "slices")
    found = rows.groupBy(*cell, "lo", "hi").applyInArrow(_pairs_in_cell(threshold), "a long, b long")
    return found.distinct()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for every row of `vectors`.

    `vectors` has `vec_id, embedding, label`; labels of any type; other columns are ignored. Rows are linked when their
    labels are equal and not null and their cosine is at least `threshold`; a vector that is null,
    empty or zero, or holds a null or non-finite component, is linked with nothing, and vectors of
    different length are not compared. Equal vectors are linked with each other. A repeated row is
    a vector of its own. No rows give no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    usable = (F.col("label").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    # one key for equal vectors; the vector itself stays part of it, so no collision can merge two
    flagged = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = flagged.filter("usable").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    folded = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = cut(folded.withColumn("rep", F.monotonically_increasing_id()))
    # labels of any type meet by a hash and are compared as they are with the pair
    pairs = cut(candidates(reps.select("rep", F.xxhash64("label").alias("label"), "embedding"), threshold))
    u = reps.select(F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("embedding").alias("u"))
    v = reps.select(F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("embedding").alias("v"))
    met = pairs.join(u, "a").join(v, "b").filter("label_a = label_b")
    links = cut(met.select("a", "b", "u", "v").mapInArrow(_verifier(threshold), "a long, b long"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(reps.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = components(links).withColumnsRenamed({"name": "rep"})
    known = (reps.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(roots, "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    known = cut(known.select("rep", "root", "least", "label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    per_rep = known.join(smallest, "root").select("label", "embedding", "n_links", "component_id")
    linked = good.join(per_rep, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = flagged.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
