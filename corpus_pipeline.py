"""A training corpus from `documents`: five stages, each on all that the one before it kept.

Every stage takes `(spark, docs, sf_dir)` and returns a DataFrame that is written as Parquet and read
again as the next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulescape.llm import language, minhash, mixing, packing, toxicity
from rulescape.llm.names import free
from rulescape.operators.scratch import clear, cut, mark


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages of the table's own labels go on, also those that switch between them; others have
    no letter, or words unlike those of the training documents."""
    name, = free(docs, "_language")
    tagged = language.with_language(docs, language.fit_language(docs), name)
    return tagged.filter(F.col(name)["learned"]).drop(name)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go on."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name, = free(docs, "_toxicity")
    tagged = toxicity.with_toxicity(docs, *toxicity.fit_toxicity(docs, labels), name)
    return tagged.filter(F.col(name)["score"] < 0.5).drop(name)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class goes on."""
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the one at which a source meets its target, in part."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens, at most 1,024, each of one document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("minhash_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, signatures and tokens are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result but the last is written to the shared scratch folder.

    What a stage wrote on its way, and the result it read, are deleted once its own result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    began = mark()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
            clear(spark, began, mark() - 1)
    return docs
