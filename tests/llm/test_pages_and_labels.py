"""Pages whose names would hide the article, hostile nesting, and labels of any type."""

from __future__ import annotations

import time

import pytest

from rulescape.llm import html, vectors

BODY = "".join(f"<p>Paragraph {i} of the article has some words that say a thing, and then another one to be long enough.</p>" for i in range(6))
MENU = "<div class='menu'><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></div><div class='footer'>Copyright 2020</div>"


@pytest.mark.parametrize("opened", ['<div class="content no-sidebar">', '<div id="page" class="has-sidebar">', '<div class="layout with-header">',
                                    '<form id="aspnetForm">', '<div class="page-header-wrapper">', '<div class="bannerless sidebar"><div>'])
def test_a_named_wrapper_keeps_its_article(opened):
    text = html.main_text(f"<html><body>{opened}{MENU}{BODY}</body></html>")
    assert text.count("Paragraph") == 6 and "Home" not in text and "Copyright" not in text


def test_titles_and_compound_names_of_text_stay_and_comments_go():
    text = html.main_text(f"<body>{MENU}<article><header class='article-header'><h1>The title</h1></header><p class='share-price'>The share price rose."
                          f"</p>{BODY}<div class='comments'>{'<p>a comment of a reader who goes on and on and on for long</p>' * 40}</div></article></body>")
    assert text.startswith("The title\nThe share price rose.\nParagraph 0") and "comment of" not in text
    assert html.main_text(f"<body><div class='comments'>{BODY}</div></body>") == ""


@pytest.mark.parametrize("page", ["<div>x" * 40000, "<b>" * 40000 + "x" + "</u>" * 40000, "<u><div>" + "<b>" * 40000 + "</u>" * 40000,
                                  "<div>x" * 40000 + "</p>" * 40000, "<p><i>x" * 40000, "<form class=ad>x" * 40000])
def test_deep_nesting_takes_linear_time(page):
    html.main_text(page[:1000])
    started = time.process_time()
    html.main_text(page)
    assert time.process_time() - started < 5


def test_smoothing_and_threshold_against_plain_loops():
    import math

    values = [0.0, 3.0, 80.0, 75.5, 2.0, 90.0, 0.0, 1.0]
    weights = {k: math.exp(-k * k / 2) for k in range(-3, 4)}
    for i, got in enumerate(html.smooth(__import__("numpy").array(values))):
        near = [(w, values[i + k]) for k, w in weights.items() if 0 <= i + k < len(values)]
        assert got == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))
    cut = html.threshold(__import__("numpy").array(values))
    low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
    assert cut == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2)


def test_labels_of_any_type_are_compared_as_they_are(spark):
    for kind, one, other in (("string", "x", "y"), ("long", 1 << 40, (1 << 40) + 1), ("int", 1, 2)):
        rows = [(0, [1.0, 0.0], one), (1, [1.0, 0.0], one), (2, [1.0, 0.0], other), (3, [1.0, 0.0], None)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
        assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3)}
