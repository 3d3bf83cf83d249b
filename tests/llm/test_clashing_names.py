"""Columns of the input that bear the names operators and stages use for themselves, in any case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulescape.llm import minhash, mixing, packing

NAMES = ["_id", "_Node", "_times", "_own", "_pieces", "_Piece", "_language", "_Toxicity", "Class_id", "n", "band", "Key", "draw", "copy", "me", "root"]


@pytest.fixture(scope="module")
def docs(spark):
    word = "the cat sat on the mat and looked at the dog that was in the house".split()
    rows = [(i, " ".join(word[(i * 3 + j) % len(word)] for j in range(30)), "en", "a") for i in range(12)] + [(20, None, "en", "b"), (3, "x y", "en", "a")]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string").select(
        "*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def _kept(df, docs):
    assert df.columns == docs.columns
    for r in df.collect():
        assert all(r[c] == f"{c}:{r.doc_id}" for c in NAMES)


def test_deduplicate_and_mix(docs):
    plain = minhash.deduplicate(docs.select("doc_id", "text"))
    out = minhash.deduplicate(docs)
    _kept(out, docs)
    assert out.count() == plain.count()
    _kept(mixing.mix_documents(docs), docs)


def test_pack(docs):
    out = packing.pack(docs.withColumn("Offset", F.lit("o")).withColumn("IDS", F.lit("i")))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "Offset" not in out.columns
    assert all(r[c] == f"{c}:{r.doc_id}" for r in out.collect() for c in NAMES)


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        _kept(stage(spark, docs, str(tmp_path)), docs)
