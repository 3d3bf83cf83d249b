"""Families of edited copies, whose members the differences from a base must find without pairing them."""

import random

import numpy as np
import pytest

from rulescape.llm import minhash


def edited(rng, words, places):
    out = list(words)
    for _ in range(places):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(10 ** 9)}"
        elif kind == 1:
            out.insert(at, f"more{rng.randrange(10 ** 9)}")
        else:
            del out[at]
    return out


def family(rng, size, most, base_there=True, offspring=0):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
    out = [base] if base_there else []
    for _ in range(60):
        copy = edited(rng, base, rng.randrange(most + 1) if base_there else most // 2 + rng.randrange(most // 2 + 1))
        out += [copy] + [edited(rng, copy, rng.randrange(4)) for _ in range(rng.randrange(offspring + 1))]
    return out


def brute(texts):
    """Smallest number of each text's class, all pairs compared."""
    sets = [set(m.tolist()) for m in minhash.members(*minhash.shingles(texts), len(texts))]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(texts))]


@pytest.mark.parametrize("turns", [0, 4])
def test_classes_of_families_equal_all_pairs(spark, monkeypatch, turns):
    monkeypatch.setattr(minhash, "TURNS", turns)
    rng = random.Random(5)
    rows = (family(rng, 150, 12) + family(rng, 90, 8, offspring=2) + family(rng, 120, 6, base_there=False)
            + family(rng, 200, 10, base_there=False, offspring=1))
    passage = [f"p{i}" for i in range(80)]
    rows += [passage + [f"x{i}y{j}" for j in range(rng.randrange(5, 60))] for i in range(60)]
    rows += [passage + edited(rng, rows[0][:40], 2) for _ in range(30)] + [["a", "b"], ["a", "b"], [], ["a", "c"]]
    texts = [" ".join(r) for r in rows]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 100 < len(set(want)) < len(texts) - 100


def test_members_tell_occurrences_apart():
    one, = minhash.members(*minhash.shingles(["a b c d e a b c d e a b c d e"]), 1)
    assert one.dtype == np.int64 and len(one) == 11 == len(set(one.tolist()))
