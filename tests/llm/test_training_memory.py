"""Training in the driver does not hold the features of all texts at once."""

import subprocess
import sys

PEAK = """
import resource
from rulescape.llm import language, words
words._tables(False), words._tables(True)
rows = [(" ".join(f"{'xyz'[i % 3]}{'abcdefghij'[(i + j) % 10]}{'klmnop'[j % 6]}st" * 2 for j in range(280)), "xyz"[i % 3]) for i in range(1600)]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
assert language.train(rows).extra["names"] == ["x", "y", "z"]
print((peak() - before) // 1024)
"""


def test_training_on_5_mb_of_text_stays_below_110_mb():
    got = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, timeout=120, check=True)
    assert int(got.stdout) < 110, got.stdout
