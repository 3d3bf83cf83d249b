"""Bounded, seeded samples of labelled rows for fitting small models."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id gives null."""
    return F.crc32(doc_id.cast("string")) % parts


def rate_of(rows: DataFrame, kind: str, per_kind: int | dict) -> dict:
    """Sampling rate of each value of `kind` (a small set of labels): all, or about `per_kind` rows."""
    counts = rows.groupBy(kind).count().collect()
    return {r[0]: min(1.0, (per_kind[r[0]] if isinstance(per_kind, dict) else per_kind) / r[1]) for r in counts}


def thinned(rows: DataFrame, kind: str, rates: dict) -> DataFrame:
    """The rows whose seeded draw by `doc_id` falls under the rate of their kind; reruns agree."""
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value, r in rates.items():
        rate = F.when(F.col(kind) == F.lit(value), F.lit(r)).otherwise(rate)
    return rows.filter(draw <= rate)


def sampled(docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int], parts: int = 5, held: int = 0) -> DataFrame:
    """`(text, label, doc_id)` of at most about `per_class[label]` training documents of each class.

    Rows whose remainder is `held` are never read. The ids are drawn from the labels alone, so
    only the texts of the sample travel. A document with several labels counts with its largest.
    """
    usable = (labels.select("doc_id", F.col(column).cast("int").alias("label"))
              .filter(F.col("label").isin(0, 1) & (id_remainder(F.col("doc_id"), parts) != held))
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = thinned(usable, "label", rate_of(usable, "label", per_class))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int]) -> list[tuple]:
    """The rows of `sampled` as `(text, label)`, in id order."""
    return [(r.text, r.label) for r in sorted(sampled(docs, labels, column, per_class).collect(), key=lambda r: r.doc_id)]


def fitted(sample: DataFrame, train: Callable[[list[dict]], object]):
    """What `train` makes of the rows of a bounded sample, in order of `doc_id`; no rows give what it makes of none.

    It runs in a task: the texts, and the memory that training takes and Python keeps, stay out of the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        model = pickle.dumps(train(sorted(rows, key=lambda r: r["doc_id"])))
        yield pa.RecordBatch.from_pydict({"model": pa.array([zlib.compress(model, 1)], pa.binary())})

    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(zlib.decompress(made.model)) if made else train([])
