"""What the driver holds: no training of the pipeline's models, and few small plans for components."""

import os
import re

import pytest

from rulescape.llm import language, samples, toxicity
from rulescape.operators import components


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i % 50} of many", ("en", "de", None)[i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)


def test_models_are_fitted_in_a_task(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "train", lambda rows: (os.getpid(), rows))
    monkeypatch.setattr(toxicity, "train", lambda rows, share: (os.getpid(), rows, share))
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic")
    pid, rows = language.fit_language(docs)
    assert pid != os.getpid()
    usable = docs.filter(samples.id_remainder(docs.doc_id, 3) != 1).filter("lang is not null").collect()
    first = {t: min((r.doc_id for r in usable if r.text == t)) for t in {r.text for r in usable}}
    assert rows == [(t, min(r.lang for r in usable if r.text == t)) for t in sorted(first, key=first.get)]
    (pid, rows, share), prior = toxicity.fit_toxicity(docs, labels)
    assert pid != os.getpid() and share == prior
    assert rows == samples.labelled(docs, labels, "toxic", toxicity.PER_CLASS) and {y for _, y in rows} == {0, 1}


def test_no_rows_or_one_class_give_no_model(spark, docs):
    none = docs.filter("doc_id < 0")
    labels = docs.selectExpr("doc_id", "0 as toxic")
    assert language.fit_language(none) is None
    assert toxicity.fit_toxicity(docs, labels) == (None, 0.0)
    assert toxicity.fit_toxicity(docs, labels.filter("false")) == (None, 0.0)
    assert toxicity.fit_toxicity(none, labels.selectExpr("doc_id", "int(doc_id % 2) as toxic"))[0] is None


def test_a_round_of_components_plans_six_shuffles(spark, tmp_path):
    spark.createDataFrame([(f"n{i + 1:03}", f"n{i:03}") for i in range(40)], "a string, b string").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")

    def shuffles(df):
        plan = re.sub(r"(?s)== Initial Plan.*", "", df._jdf.queryExecution().executedPlan().toString())
        return len(re.findall(r"\bExchange |BroadcastExchange ", plan))

    assert shuffles(components._large_star(edges)) <= 3 and shuffles(components._small_star(edges)) <= 3
    assert not components._is_star_forest(edges)
    got = {r.name: r.root for r in components.components(edges).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(41)}


def test_star_forests_are_told(spark):
    of = lambda pairs: components._is_star_forest(spark.createDataFrame(pairs, "a string, b string"))
    assert of([("b", "a"), ("c", "a"), ("e", "d")])
    assert not of([("b", "a"), ("c", "b")]) and not of([("c", "a"), ("c", "b")])
