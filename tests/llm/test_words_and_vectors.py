"""Centroid clustering, transducer encoding and spelling variants on awkward rows, against brute force and the library."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulescape.llm import bpe, centroids, transducer, variants

# ---- 11 centroids --------------------------------------------------------------


def _vectors():
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss((i % 5) - 2, 0.4), 3) for _ in range(4)]) for i in range(80)]
    rows += [(200, [0.5] * 4), (201, [0.5] * 4), (202, [-0.5] * 4), (7, rows[7][1]), (7, [9.0, -9.0, 0.001, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    bad = [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 0.0, 0.0]), (304, [1.0, float("nan"), 0.0, 0.0]),
           (305, [float("inf")] * 4), (306, [0.0, 0.0, 0.0, float("-inf")])]
    return rows, bad


def _lloyd(rows, k, rounds, scale, seed):
    """The contract by plain loops."""
    x = [(i, [int(np.floor(scale * v)) for v in e]) for i, e in rows]
    def draw(r):
        return hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]
    centre = [list(v) for _, v in sorted(x, key=draw)[:k]]
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in x:
            groups[nearest(v)[1]].append(v)
        for j, members in groups.items():
            centre[j] = [sum(col) // len(members) for col in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in x]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted((repr((i, c, d, inertia[c], sum(inertia.values()), names[c])) for i, c, d in found))


@pytest.mark.parametrize("k,rounds", [(6, 5), (200, 1), (1, 2), (3, 0)])
def test_clusters_equal_plain_loops(spark, k, rounds):
    rows, bad = _vectors()
    df = spark.createDataFrame([(i, e, 1, "c") for i, e in rows + bad], "vec_id long, embedding array<double>, cluster int, Distance string").repartition(3)
    got = centroids.assignments(df, k=k, rounds=rounds, dim=4)
    assert sorted(repr(tuple(r)) for r in got.collect()) == _lloyd(rows, k, rounds, 256, 2)


def test_no_vectors_and_components_too_large(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    got = centroids.assignments(none)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no exact squared distance"):
        centroids.assignments(huge, dim=2).collect()


# ---- 12 encoding ---------------------------------------------------------------

PATH = transducer.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoders():
    return bpe.Encoder(PATH), bpe.Encoder(PATH, size=7)


TEXTS = ["", " \n\t", "don't 'season ''re we'll", "ΣΑΣ Σ", "İstanbul STRAßE é é ȩ́", "a<|endoftext|>B<|startoftext|>", "가각 ᄀ", "日本語 １２", "x\x1cy\x85z\xa0w",
         "͸\U0001d7d8\U00010d4a￾", "?!" * 300 + "'s", "ab" * 5000, "́" * 100, "word " * 3000, "a" * 40000 + "'re" + "!" * 40000]


def test_ids_equal_the_library(library, encoders):
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        for e in encoders:
            assert e.encode(text) == want, text[:40]
            n, ids, decoded = bpe.Digester(e).digest(text)
            assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
            assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeinrst'sdlmΣéß̧́ 1\n!\"\x1c<|endoftext|>각日͸"), max_size=60))
def test_slices_do_not_change_ids(library, encoders, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert [e.encode(text) for e in encoders] == [want, want]


def _tiny(tmp_path, seed):
    """A small random merge list over a few letters, so that chains of merges are common."""
    rng = random.Random(seed)
    letters = transducer.byte_letters()
    vocab = {t: i for i, t in enumerate([*letters, *(c + "</w>" for c in letters)])}
    known, merges = ["a", "b", "c", "a</w>", "b</w>"], []
    for _ in range(200):
        a, b = rng.choice([t for t in known if "<" not in t]), rng.choice(known)
        if len(a + b) < 12 and a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
            known.append(a + b)
    path = tmp_path / f"tiny{seed}.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": None}}))
    return transducer.MergeList(str(path))


def test_tokens_are_stable_after_the_lookahead(tmp_path):
    """Parts of a word, cut anywhere, give the tokens of the whole; no token within the lookahead rule ever changes."""
    rng = random.Random(1)
    for seed in range(4):
        merges = _tiny(tmp_path, seed)
        for _ in range(60):
            word = bytes(rng.choice(b"aaabbc") for _ in range(rng.randrange(1, 400)))
            whole = merges.apply([*(merges.inner[b] for b in word[:-1]), merges.last[word[-1]]])
            machine, out, at = transducer.Transducer(merges, block=3), [], 0
            while at < len(word):
                step = rng.randrange(1, 9)
                out += machine.feed(word[at:at + step])
                at += step
                assert len(machine.held) <= merges.reach + 3 + 9
            assert out + machine.finish() == whole
            cut = rng.randrange(len(word))
            part, end = merges.apply([merges.inner[b] for b in word[:cut]]), 0
            for i, t in enumerate(part):
                end += merges.size[t]
                if end > cut - merges.reach:
                    break
                assert whole[i] == t


def test_decoder_is_incremental(encoders, library):
    e = encoders[0]
    text = "héllo wörld 日本 <|endoftext|> ok"
    ids = e.encode(text)
    machine = transducer.Decoder(e.merges)
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "héllo wörld 日本 <|endoftext|>ok "
    spaced = transducer.Decoder(e.merges, spaced=True)
    assert "".join(spaced.feed([i]) for i in [*ids, 10 ** 9]) == library.decode([*ids, 10 ** 9], skip_special_tokens=False)
    assert transducer.Decoder(e.merges).feed([e.merges.inner[0xC3], e.merges.last[0x41]]) == "�A "


def test_encode_decode_columns(spark, library):
    rows = [(1, "One two", "x"), (1, "One two", "x"), (2, None, None), (None, "", "y"), (3, "z" * 100_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.decode(bpe.encode(docs), spaced=True)
    got = sorted(((r.doc_id or 0, r.text or "", r.ids, r.decoded) for r in out.collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, t or "", ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError, match="IDS"):
        bpe.encode(docs.withColumn("ids", F.lit(1)), "IDS")
    assert bpe.digests(docs).count() == 5 and bpe.digests(docs.filter("false")).count() == 0


# ---- 13 spelling variants ------------------------------------------------------


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _groups(rows, least):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in n if _one_edit(w, v)] for w in n}
    form = {w: (best if n[best] >= 2 * n[w] else None) if (best := min(v, key=lambda x: (-n[x], x), default=None)) else None for w, v in near.items()}
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(repr((w, form[w], root(w), c, len(near[w]), n[form[w]] if form[w] else None)) for w, c in n.items())


@pytest.mark.parametrize("levels", [24, 6])
def test_variants_equal_brute_force(spark, levels):
    rng = random.Random(8)
    base = ["house", "mouse", "theatre", "colour", "öffnen", "aaaaa", "aaaaaa", "aaaaaaa", "banana" * 6, "Straße", "ÉTOILE"]
    pool = list(base)
    for w in base * 3:
        i = rng.randrange(len(w))
        pool += [w[:i] + w[i + 1:], w[:i] + rng.choice("aeo") + w[i:], w[:i] + rng.choice("aeo") + w[i + 1:]]
    rows = [(i, " ".join(rng.choices(pool, weights=[1 + 40 // (j + 1) for j in range(len(pool))], k=40)) + "!9x÷×") for i in range(40)]
    rows += [(1, None), (2, ""), (None, "house houses houses houses"), (40, "x" * 3000 + " " + "x" * 2999), (40, "x" * 3000 + " " + "x" * 2999),
             (41, "x" * 3000), (42, "x" * 2999), (43, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, N int").repartition(3)
    got = variants.spelling_groups(docs, levels)
    assert sorted(repr(tuple(r)) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == _groups(rows, 3)


def test_no_words(spark):
    none = spark.createDataFrame([(1, None), (2, "short w")], "doc_id long, text string")
    assert variants.spelling_groups(none).count() == 0


def test_pairs_of_dense_words(spark):
    """Every word over two letters: the trie is full and pairs are met on several ways."""
    words = ["".join(w) for n in (4, 5) for w in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {tuple(sorted(p)) for p in itertools.combinations(words, 2) if _one_edit(*p)}
    for levels in (3, 4, 10):
        got = [tuple(r) for r in variants.near_words(df, levels).collect()]
        assert len(got) == len(set(got)) and set(got) == want
