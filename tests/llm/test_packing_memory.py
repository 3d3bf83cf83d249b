"""Packing holds the ids of a few texts at a time, however many rows come in a batch."""

import subprocess
import sys

import pyarrow as pa

from rulescape.llm import packing, words

PEAK = """
import resource
import pyarrow as pa
from rulescape.llm import packing, tokens
encoder = packing._encoder(packing.default_tokenizer())
tokens._classes()
part = pa.array([" ".join(f"word{(i * 7 + j) % 5000}" for j in range(400)) for i in range(10000)])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
assert sum(map(len, packing.sequences(encoder, part, True))) == 10000
print((peak() - before) // 1024)
"""


def test_ten_thousand_texts_stay_below_100_mb():
    got = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, timeout=120, check=True)
    assert int(got.stdout) < 100


def test_slices_hold_every_text_in_order():
    encoder = packing._encoder(packing.default_tokenizer())
    texts = [f"text {i} " * (i % 5) for i in range(1201)] + [None, "long " * words.CHARS, "end"]
    runs = list(packing.sequences(encoder, pa.array(texts), True))
    assert max(map(len, runs)) <= words.TEXTS and len(runs) > 3
    got = [doc for run in runs for doc in run.to_pylist()]
    want = list(packing.pieces_of(encoder, texts, True))
    assert len(got) == len(texts)
    for g, w in zip(got, want):
        assert [(p["start"], p["length"], p["doc_tokens"], p["ids_crc32"], p["ids"]) for p in g] == [
            (s, n, t, c, i.tolist()) for s, n, t, c, i in w]
    assert list(packing.sequences(encoder, pa.array([], pa.string()), True)) == []
    assert all(p["ids"] is None for run in packing.sequences(encoder, pa.array(texts[:9]), False) for d in run.to_pylist() for p in d)
