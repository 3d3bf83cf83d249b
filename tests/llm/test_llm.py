"""The training-data operators on awkward rows, against brute force, SQL and exact round trips."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulescape.llm import (crf, html, language, licenses, minhash, mixing, packing, quality, spotsigs, sql, tokens, toxicity,
                           vectors, words)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, key string, class string"
EN = "the of and to in is that it for was on with as be by this are at from thing there other".split()
DE = "der die und in den von zu das mit sich im für des auf ist nicht dem ein keiten schaft".split()


def _sentence(rng, pool, n):
    return " ".join(rng.choice(pool) + rng.choice(["", "", "ing", "keit", "er"]) for _ in range(n))


def _rows():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang, pool = (("en", EN), ("de", DE))[i % 2]
        text = _sentence(rng, pool, rng.randint(1, 80)).capitalize() + ".\n" + _sentence(rng, pool, 20)
        rows.append([i, text, lang, ("a", "b", None)[i % 3], None])
    long = _sentence(rng, EN, 6000)
    rows += [[100, long, "en", "a", 1], [101, long + " indeed", "en", "b", 1], [102, long, "en", "c", 1],
             [103, None, None, None, None], [104, "", "en", "a", 0], [105, "", None, "", 0], [106, "  \n\t ", "en", "a", 5],
             [107, "123 456!!", "de", "d", 9], [108, "日本語 テキスト", None, "d", 8], [109, "x" * 3000, "en", "é", 3000],
             [110, "Licensed under the Apache License, Version 2.0. <|endoftext|> don't", "en", "a", 1],
             [7, "the second text of seven", "en", "a", 1], [8, rows[8][1], "en", "b", 1], [8, rows[8][1], "en", "b", 1],
             [None, "no id of any kind here", "en", None, 1]]
    return [tuple(r) + (0.5, "s", "k", "c") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, int(i % 4 > 0), int(i % 7 == 0)) for i in range(60)] + [(7, 1, 1), (None, 1, 1), (5000, 0, 0), (3, None, None)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def _same_as_sql(df, query, **tables):
    db = duckdb.connect()
    for name, rows in tables.items():
        db.register(name, rows)
    cur = db.execute(query)
    names = [c[0] for c in cur.description]
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(df.select(*names).collect()) == plain(cur.fetchall())


# ---- 1 packing -----------------------------------------------------------------

def test_packing_is_an_exact_round_trip(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    want = collections.Counter(tuple(t.encode(r[1] or "", add_special_tokens=False).ids) + (0,) for r in rows)
    out = packing.pack(docs.withColumn("bucket", F.lit("clash")).withColumn("row", F.monotonically_increasing_id())).collect()
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    by_row = collections.defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and r.length <= 1024 and r.length & (r.length - 1) == 0 and r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_row[r.row].append(r)
    got = collections.Counter()
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        ids = [i for p in pieces for i in p.ids]
        assert [p.start for p in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert {p.doc_tokens for p in pieces} == {len(ids)}
        got[tuple(ids)] += 1
    assert got == want


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


@given(st.integers(1, 10**7))
def test_binary_lengths(n):
    parts = packing.binary_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
    assert len({p for p in parts if p < 1024}) == len([p for p in parts if p < 1024])


_ENCODER = []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZé 日\n\t's re've.,!1٣　'll'd", max_size=40), max_size=8))
def test_tokens_are_the_library_s(texts):
    if not _ENCODER:
        _ENCODER.append(tokens.Encoder(packing.default_tokenizer()))
    ids, counts = _ENCODER[0].encode(texts)
    want = [_ENCODER[0].tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_a_batch_larger_than_the_piece_table(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 7)
    coder = tokens.Encoder(packing.default_tokenizer())
    for texts in (["one two three"], ["one four two five six seven three eight"], ["eight", "one two nine ten eleven twelve", "a b c d e f g h i j"]):
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        ids, counts = coder.encode(texts)
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


# ---- 2 and 4, random fields -------------------------------------------------------

def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    emissions, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first, size = np.array([0, 3, 4]), np.array([3, 1, 3])
    gamma, pairs = crf.forward_backward(emissions, first, size, move, pairs=True)
    want_pairs = np.zeros((3, 3))
    for f, n in zip(first, size):
        total, mass, both = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            p = math.exp(sum(emissions[f + i, s] for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, s in enumerate(path):
                mass[i, s] += p
            for a, b in zip(path, path[1:]):
                both[a, b] += p
        np.testing.assert_allclose(gamma[f:f + n], mass / total, rtol=1e-6)
        want_pairs += both / total
    np.testing.assert_allclose(pairs, want_pairs, rtol=1e-6)


def test_words_offsets_and_hashes():
    w = words.split(["Über alles", "", "a1b ÄÖ", "über"], digits=False)
    assert [w.doc.tolist(), (w.start - w.base[w.doc]).tolist()] == [[0, 0, 2, 2, 2, 3], [0, 5, 0, 2, 4, 0]]
    h = words.word_hash(w)
    assert h[0] == h[5] and len(set(h.tolist())) == 5


def test_toxicity_finds_spans_and_spares_others():
    rng = random.Random(1)
    bad = ["grumblo", "snarkig"]
    made = []
    for i in range(300):
        text = _sentence(rng, EN, 40).split()
        if i % 3 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        made.append((" ".join(text), int(i % 3 == 0)))
    model = toxicity.train(made, 1 / 3)
    got = toxicity.score_texts(model, 0.3, ["so the GRUMBLO is here", "the thing is here", "", None, "!!", "x " * 30000 + "snarkig"])
    assert [g["score"] >= 0.5 for g in got] == [True, False, False, False, False, True]
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(7, 14)] and got[5]["spans"][0]["start"] == 60000


def test_toxicity_rows(docs, labels, none):
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.toxicity_scores(none, labels).count() == 0
    unlabelled = toxicity.toxicity_scores(docs, labels.filter("false")).collect()
    assert {r.score for r in unlabelled} == {0.0}


def test_held_out_labels_are_not_read(docs, labels):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(repr, toxicity.toxicity_scores(docs, labels).collect())) == sorted(map(repr, toxicity.toxicity_scores(docs, flipped).collect()))


def test_language_rows(docs, none):
    out = {(r.doc_id, r.held_out): r for r in language.language_predictions(docs).collect()}
    by_id = {k[0]: r for k, r in out.items()}
    assert {by_id[i].lang_pred for i in (103, 104, 105, 106, 107)} == {"und"}
    assert all(by_id[i].lang_pred == ("en", "de")[i % 2] for i in range(9, 60))
    assert all(0 <= r.score <= 1 and r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by_id.items())
    assert language.language_predictions(none).count() == 0
    assert {r.lang_pred for r in language.language_predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_follows_a_switch():
    rng = random.Random(2)
    model = language.train([(_sentence(rng, pool, 60), name) for _ in range(60) for name, pool in (("en", EN), ("de", DE))])
    text = "that was for this thing. nicht auf den ist von"
    got = language.label_words(model, text)
    assert [lang for _, _, lang, _ in got] == ["en"] * 5 + ["de"] * 5 and text[got[5][0]:got[5][1]] == "nicht"


# ---- 3 fingerprints -----------------------------------------------------------

def test_fingerprints_against_sql(docs, rows):
    import pandas as pd

    table = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    _same_as_sql(spotsigs.edited_fingerprints(docs), sql.OP3, documents=table)


def test_fingerprints_of_few_rows(spark, none):
    assert spotsigs.edited_fingerprints(none).count() == 0
    one = spotsigs.edited_fingerprints(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab").hexdigest() and one.near_edited == one.near_next == 1.0
    two = {r.doc_id: r for r in spotsigs.edited_fingerprints(spark.createDataFrame([(1, "abcdef"), (None, None)], "doc_id long, text string")).collect()}
    assert two[1].edited_sha256 == hashlib.sha256(b"abcd").hexdigest() and two[None].fingerprint == "" and two[None].near_next == 0.0


def test_fingerprint_runs_of_common_words(spark):
    text = "der " * 20000 + "Haus Baum"
    got = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert spotsigs.with_fingerprint(got).first().fingerprint == [hashlib.md5("der:haus:baum".encode()).hexdigest()[:8]]


def test_fingerprint_classes_against_brute_force(spark):
    rng = random.Random(9)
    base = [_sentence(rng, EN + [f"word{i}" for i in range(200)], 60).split() for _ in range(12)]
    made = []
    for i, b in enumerate(base):
        for j in range(6):
            t = list(b)
            for _ in range(j):
                t[rng.randrange(len(t))] = f"edit{i}{j}"
            made.append((len(made), " ".join(t)))
    made += [(500, ""), (501, None), (502, made[0][1])]
    prints = spotsigs.with_fingerprint(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "fingerprint")
    sets = {r.doc_id: set(r.fingerprint) for r in prints.collect()}
    want = _classes(sets, lambda a, b: 1.0 if not a and not b else len(a & b) / max(len(a | b), 1) >= 0.8)
    assert {r.doc_id: r.class_id for r in spotsigs.near_copies(prints).collect()} == want


def _classes(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in items:
        for b in items:
            if a < b and linked(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


# ---- 5 mixing ------------------------------------------------------------------

def test_mix_against_sql(docs, rows):
    import pandas as pd

    table = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    _same_as_sql(mixing.mix_plan(docs), sql.OP5, documents=table)


def test_mix_meets_its_targets(docs, none):
    out = mixing.mix_plan(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").dropDuplicates(["doc_id", "size", "source"])
    assert all(r.taken <= 2 * r["size"] for r in out.collect())
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).columns == none.columns


def test_mixed_rows_hold_the_words_taken(docs):
    plan = mixing.mix_plan(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words_out = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    both = plan.join(words_out, plan.doc_id.eqNullSafe(words_out.doc_id), "left").select("taken", F.coalesce("n", F.lit(0)).alias("n"))
    assert all(r.taken == r.n for r in both.collect())


def test_water_filling_against_a_loop(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 40):
        sizes = [(f"s{i:03d}", rng.choice([0, 1, 5, 100, 10**6])) for i in range(n)]
        got = {r.key: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "key string, source_size long")).collect()}
        weight = {k: (5, 2, 1)[i % 3] for i, (k, _) in enumerate(sizes)}
        size, held, total = dict(sizes), set(), 1.5 * sum(s for _, s in sizes)
        while True:
            free = [k for k in size if k not in held]
            rest = total - sum(2 * size[k] for k in held)
            over = {k for k in free if rest * weight[k] / sum(weight[x] for x in free) >= 2 * size[k]}
            if not over:
                break
            held |= over
        for k in size:
            want = 2 * size[k] if k in held else rest * weight[k] / sum(weight[x] for x in free)
            assert got[k] == pytest.approx(want)


# ---- 6 near duplicates ------------------------------------------------------------

def _bag(text):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [text or ""]
    return collections.Counter(grams)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(500)]
    made = []
    for _ in range(10):
        b = [rng.choice(pool) for _ in range(80)]
        for j in range(8):  # a chain of edits: the ends are far apart, the neighbours near
            b = list(b)
            b[rng.randrange(80)] = f"e{len(made)}"
            made.append((len(made) * 3, " ".join(b)))
    made += [(1000, "same same same same same same"), (1001, "same " * 7), (1002, ""), (1003, None), (1004, "!!"), (1005, "one two"), (1006, "One, two")]
    made += [(2000, made[0][1])] * 3
    docs = spark.createDataFrame([(*r, "extra") for r in made], "doc_id long, text string, node string").repartition(4)
    bags = {i: _bag(t) for i, t in made}
    near = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9
    want = _classes(bags, near)
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    stay = minhash.deduplicate(docs)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values())) and stay.columns == docs.columns
    assert minhash.near_duplicates(docs.filter("false")).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    element = np.arange(300, dtype=np.uint64)
    a, b = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    doc = np.repeat([0, 1], 300)
    agree = []
    for trial in range(40):
        e = np.tile(element + np.uint64(trial * 1000), 2)
        s = minhash.dart_minhash(doc, e, np.concatenate([a, b]), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


# ---- 7 pages ---------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/>Home</a></ul></nav><!-- ad --><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>%s
<aside>See also</aside><div id="comments"><p>First!</p></div><form><input value=x>Name</form><footer>&copy; us</footer>"""
BODY = "<h1>A &amp; B</h1><p><b>One\n two&nbsp;three.<br><p>Four <i>five</i></p><ul><li>six<li>seven</ul><p>.</p><p>" + "long text " * 50


@pytest.mark.parametrize("holder", ["<article>%s</article>", "<main>%s</main>", "<div class='post-content'>%s</div>", "<section><div>%s</div></section>"])
def test_page_text(holder):
    want = "A & B\nOne two three.\nFour five\nsix\nseven\n.\n" + ("long text " * 50).strip()
    assert html.main_text(PAGE % (holder % BODY)) == want


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>a<p>b", "x"), (3, "u", "<p>a<p>b", "x"), (None, "v", "plain", "x")],
                                  "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.page_texts(pages).collect()) == [
        (0, "plain", 5), (1, "", 0), (2, "", 0), (3, "a\nb", 3), (3, "a\nb", 3)]
    assert html.page_texts(pages.filter("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pabdiv &;#!-[]\"'=x\n", max_size=60))
def test_any_markup_is_read(text):
    out = html.main_text(text)
    assert out == "\n".join(x for x in out.split("\n") if x == x.strip() and x)


# ---- 8 licences -------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
    return len(w), places


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["under", "THE", "mit", "license", "Apache", "version", "2", "cc", "BY", "nc", "é", "x-y", "", "\n", "(", "gpl", "v3"]), max_size=30))
def test_base_places_against_brute_force(parts):
    text = " ".join(parts)
    n, places, found = licenses.scan(text)
    assert (n, places) == _base(text)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_license_labels():
    assert len(licenses.rules()) > 300
    label = lambda t: {r.label for _, _, r in licenses.scan(t)[2]}
    assert label("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3"}
    assert label("SPDX-License-Identifier: LGPL-2.1") == {"lgpl-2.1"}
    assert label("Creative Commons Attribution-NonCommercial 4.0 International") == {"cc-by-nc-4.0"}
    assert label("mit der Lizenz") == label("the version of the license") == set()


@pytest.mark.parametrize("text, want", [
    ("GPL v2", "gpl-2"), ("MPL v2.0", "mpl-2"), ("GNU General Public License v3.0", "gpl-3"), ("Apache License v2.0", "apache-2"),
    ("GPLv3", "gpl-3"), ("GPLv2.0", "gpl-2"), ("LGPLv2.1", "lgpl-2.1"), ("LGPLv21", "lgpl-2.1"), ("GPL3", "gpl-3"),
    ("the GNU AGPLv3", "agpl-3"), ("Released under the LGPLv3", "lgpl-3"), ("under GPLv2 or later", "gpl-2"), ("MPLv2", "mpl-2"),
    ("EUPLv1.2", "eupl-1.2"), ("SPDX-License-Identifier: GPLv3", "gpl-3"), ("CC BY-SA v4.0", "cc-by-sa-4.0"),
    ("Neither the name of the " + "very " * 40 + "long holder nor the names of its contributors may be used to endorse", "bsd-3"),
    ("gplv", None), ("gplv34", None), ("php3", None)])
def test_license_versions_in_one_word_and_long_holders(text, want):
    assert {r.label for _, _, r in licenses.scan(f"see {text} here")[2]} == ({want} if want else set())


def test_license_rows(docs, rows, none):
    out = licenses.license_scan(docs).collect()
    assert sorted((r.n_words, r.n_base) for r in out) == sorted((n, len(p)) for n, p in (_base(r[1]) for r in rows))
    hit = next(r for r in out if r.doc_id == 110)
    assert (hit.first_word, hit.last_word, hit.base_labels, hit.labels) == (3, 3, "apache-2", "apache-2") and 0 < hit.score <= 1
    empty = next(r for r in out if r.doc_id == 103)
    assert (empty.n_words, empty.first_word, empty.labels, empty.score) == (0, None, "", 0.0)
    assert licenses.license_scan(none).count() == 0


# ---- 9 vectors --------------------------------------------------------------------

def _vectors():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 16))
    made = [(i, [float(x) for x in centre[i % 4] + rng.normal(size=16) * (0.02 if i % 3 else 0.6)], i % 2 if i % 11 else None) for i in range(240)]
    made += [(300, made[5][1], 1), (301, made[5][1], 1), (302, [2 * x for x in made[5][1]], 1), (303, None, 1), (304, [0.0] * 16, 1),
             (305, [float("nan")] + [1.0] * 15, 1), (306, [float("inf")] + [1.0] * 15, 1), (307, [None] + [1.0] * 15, 1), (308, [], 1),
             (309, [1.0], 1), (310, [3.0], 1), (311, [-1.0], 1), (312, [1e300, 1e300], 0), (313, [1e-300, 1e-300], 0), (314, [1.0, 2.0, 3.0], 0)]
    return made


def test_vectors_against_brute_force(spark):
    made = _vectors()
    df = spark.createDataFrame([(*r, 9) for r in made], "vec_id long, embedding array<double>, label int, copies int").repartition(3)
    usable = {i: (np.array(v, float) / np.abs(v).max(), lab) for i, v, lab in made
              if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.linalg.norm(v), lab) for i, (v, lab) in usable.items()}
    linked = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] >= 0.98
    root = _classes(unit, linked)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(made)
    for i, _, _ in made:
        links = sum(linked(unit[i], unit[j]) for j in unit if j != i) if i in unit else 0
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, root.get(i, i), root.get(i, i) == i), i
    assert vectors.near_vectors(df.filter("false")).count() == 0


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 16)
    test_vectors_against_brute_force(spark)


# ---- 10 quality --------------------------------------------------------------------

def test_quality_votes():
    rng = random.Random(3)
    made = []
    for i in range(200):
        t = _sentence(rng, EN, 60)
        made.append((" | ".join(t.split()) if i % 4 == 0 else t, int(i % 4 > 0)))
    model = quality.train(made, 0.75)
    got = quality.score_texts(model, 0.75, [" | ".join(_sentence(rng, EN, 50).split()), _sentence(rng, EN, 50), "", None, "x" * 200000])
    assert got[0] < 0.3 <= got[1] and got[2] == got[3] == 0.75 and 0 <= got[4] <= 1
    cos = model.vectors @ model.vectors.T
    z = model.vectors[:3]
    near = np.argsort(-cos[:3], axis=1)[:, :quality.NEIGHBOURS]
    sim = np.maximum(np.take_along_axis(cos[:3], near, 1).astype(float), 0) ** 4 * model.weights[near]
    np.testing.assert_allclose(quality.vote(model, z), (sim * model.labels[near]).sum(1) / sim.sum(1), rtol=1e-5)


def test_quality_rows(docs, labels, none):
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.filter("false")).collect()} == {0.5}
