"""Memory of a worker does not follow the number of short texts in a batch."""

import subprocess
import sys

import pytest

from rulescape.llm import words

PEAK = """
import resource, sys
import pyarrow as pa
from rulescape.llm import minhash, quality, words
words._tables(True), words._tables(False)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
texts = [f"one two w{i}" for i in range(10000)]
if sys.argv[1] == "sign":
    assert sum(map(len, minhash._sign(iter([pa.array(texts)])))) == 10000
else:
    assert sum(len(quality.counts(x)) for _, x in words.batches(texts)) == 10000
print((peak() - before) // 1024)
"""


def test_batches_are_bounded_by_texts_and_code_points():
    texts = ["a"] * 1201 + [None, "b" * (words.CHARS + 1), "c"]
    runs = list(words.batches(texts))
    assert [t for _, run in runs for t in run] == [t or "" for t in texts]
    assert all(len(run) <= words.TEXTS and (len(run) == 1 or sum(map(len, run)) <= words.CHARS) for _, run in runs)
    assert [first for first, _ in runs] == [0, 500, 1000, 1202, 1203]


@pytest.mark.parametrize("part", ["sign", "quality"])
def test_ten_thousand_short_texts_stay_below_200_mb(part):
    got = subprocess.run([sys.executable, "-c", PEAK, part], capture_output=True, text=True, timeout=120, check=True)
    assert int(got.stdout) < 200
