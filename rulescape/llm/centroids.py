"""Centroid clustering over an incremental matrix of exact integer dot products.

Every vector keeps its dot product with every centroid in a written table. After a round only those
components of a centroid that changed touch that matrix: `x . new = x . old + sum of x[i] * change[i]` over
the nonzero changes. The nearest centroid is the argmin of `|c|^2 - 2 x . c`, all in 64-bit integers, so
no rounding decides a tie and every rerun agrees.

What travels: a round reads and writes the table once and sends one sum per centroid and component to
the driver (`k * dim` numbers, both parameters). A centroid that holds a third of all vectors is summed
in partial sums first. The table of a round is written to the shared scratch folder, so a lost executor
recomputes only its own tasks; the table before it is deleted once the next one is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scratch

#: With components in this range a squared distance of up to 64 components fits into 64 bits.
LARGEST = 1 << 27

_STEP = "struct<dots:array<bigint>,cluster:int,distance:bigint>"


def integer_vectors(vectors: DataFrame, dim: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`(vec_id, x)`: `floor(scale * component)` of every vector of `dim` components, none null or non-finite.

    Components beyond `LARGEST` are an error, as a squared distance would not fit into a long.
    """
    value = F.col(vector).cast("array<double>")

    def usable(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def whole(v: Column) -> Column:
        scaled = F.floor(v * float(scale))
        return F.when(F.abs(v) * float(scale) < float(LARGEST), scaled).otherwise(
            F.raise_error(F.lit(f"a component beyond {LARGEST // scale} has no exact squared distance in 64 bits")).cast("bigint"))

    kept = vectors.select(F.col(vec_id).alias("vec_id"), value.alias("v")).filter(
        (F.size("v") == dim) & F.coalesce(F.forall("v", usable), F.lit(False)))
    return kept.select("vec_id", F.transform("v", whole).alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The `k` vectors with the smallest sha256 of `seed:vec_id`, in that order; equal ids go by their components.

    A null id is hashed as `null`. Fewer than `k` vectors give fewer centroids.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r.x) for r in kept.select("x", draw.alias("draw")).orderBy("draw", "x").limit(k).collect()]


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """`(centroid, components, amounts)` of every centroid that changed: its nonzero component changes."""
    out = []
    for c in range(len(new)):
        moved = new[c] - old[c]
        at = np.flatnonzero(moved)
        if len(at):
            out.append((c, at, moved[at]))
    return out


def assign(x: np.ndarray, dots: np.ndarray, moved: list, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(dots, cluster, distance)` after adding the changes to the matrix in place; ties go to the smaller number."""
    for c, at, amount in moved:
        dots[:, c] += x[:, at] @ amount
    cost = squares[None, :] - 2 * dots
    cluster = np.argmin(cost, axis=1)
    distance = (x * x).sum(axis=1) + cost[np.arange(len(x)), cluster]
    return dots, cluster, distance


def _step(moved: list, squares: np.ndarray, dim: int):
    """Column function: new dot products, cluster and distance of vectors and their products so far (null: none yet)."""
    k = len(squares)

    @F.arrow_udf(_STEP)
    def step(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, dots in parts:
            n = len(x)
            matrix = np.asarray(x.flatten()).astype(np.int64).reshape(n, dim)
            held = np.zeros((n, k), np.int64) if dots.null_count else np.array(dots.flatten()).astype(np.int64).reshape(n, k)
            held, cluster, distance = assign(matrix, held, moved, squares)
            ends = pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32))
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(held.ravel())), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["dots", "cluster", "distance"])

    return step


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """`(assignment, centroids)`: one row `(vec_id, x, cluster, distance)` per kept vector, and the final centroids.

    Vectors that are null, of another length, or hold a null or non-finite component are left out; repeated rows and
    ids are kept and count each; other columns of `vectors` are not read. Each of `rounds` rounds assigns all vectors and
    replaces every centroid that has some by their componentwise floored mean; then all are assigned once
    more. Without any kept vector the assignment is empty and there are no centroids.
    """
    spark = vectors.sparkSession
    state = scratch.cut(integer_vectors(vectors, dim, scale, vec_id, vector).withColumn("dots", F.lit(None).cast("array<bigint>")))
    new = np.array(first_centroids(state.select("vec_id", "x"), k, seed), dtype=np.int64).reshape(-1, dim)
    old = np.zeros_like(new)
    if not len(new):
        return state.select("vec_id", "x", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    for turn in range(rounds + 1):
        moved = changes(old, new)
        if turn and not moved:
            break  # nothing changed, so no later round changes anything
        before = scratch.mark()
        step = _step(moved, (new * new).sum(axis=1), dim)
        state = scratch.cut(state.select("vec_id", "x", step("x", "dots").alias("s")).select(
            "vec_id", "x", "s.dots", "s.cluster", "s.distance"))
        scratch.clear(spark, before - 1, before)
        if turn == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dim)])
        old, new = new, new.copy()
        for row in sums.collect():  # one row per centroid
            new[row.cluster] = [row[f"s{i}"] // row.n for i in range(dim)]
    return state.select("vec_id", "x", "cluster", "distance"), new.tolist()


def assignments(vectors: DataFrame, **settings) -> DataFrame:
    """`(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)` of every kept vector."""
    found, centroids = cluster(vectors, **settings)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row per centroid
    own = F.array(*[F.lit(per.get(c, 0)).cast("bigint") for c in range(len(centroids))]) if centroids else F.lit(None).cast("array<bigint>")
    names = F.array(*[F.lit(d) for d in digests]) if centroids else F.lit(None).cast("array<string>")
    return found.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(per.values())).cast("bigint").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))
