"""Long texts are worked on in parts: the parts give what the whole gives, and memory stays within ten times the text."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from tokentally.llm import neardup, ppm, quality
from tokentally.llm.shared import raw_parts, word_hash_parts, word_hashes


def test_parts_are_the_whole(words, monkeypatch):
    rng = random.Random(3)
    texts = [rng.choice([" ", "\n", "\t\r"]).join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 900]))) for _ in range(40)] + ["", " ", "x" * 5000, " lead and trail "]
    raw = [t.encode() for t in texts]
    for size in (1, 7, 300, 10**9):
        back = {}
        for part in raw_parts(raw, size):
            for i, r in part:
                back[i] = back.get(i, b"") + r
        assert [back[i] for i in range(len(raw))] == raw
    assert len(list(raw_parts(raw, 300))) > 20
    long = " ".join(rng.choices(words, k=700_000))
    assert len(list(word_hash_parts([long, "a b", long]))) > 4
    flat, n = word_hashes([long, "a b", long])
    w = long.split()
    one = dict(zip(words, word_hashes([" ".join(words)])[0].tolist(), strict=True))
    assert n.tolist() == [len(w), 2, len(w)] and flat[: len(w)].tolist() == [one[x] for x in w] and (flat[: len(w)] == flat[-len(w) :]).all()
    for size in (1, 5, 100):
        for a, b in zip(ppm.count_grams(raw, size), ppm.count_grams(raw, 10**9), strict=True):
            assert (a == b).all()
        got = [np.concatenate([g for at, to, g, s in ppm.gram_parts([r], size)]) for r in raw]
        assert all((g == next(ppm.gram_parts([r], 10**9))[2]).all() for g, r in zip(got, raw, strict=True))
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    want = model.score(texts)
    monkeypatch.setattr(quality, "AT_ONCE", 60)
    assert np.allclose(model.score(texts), want, atol=1e-9)


SCRIPT = """
import random, resource, sys
import numpy as np
from tokentally.llm import neardup, ppm, quality
from tokentally.llm.shared import powers
what = sys.argv[1]
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(5000)]
text = " ".join(rng.choices(words, k=6_000_000))
size = len(text)
model = quality.QualityModel(np.zeros(1 << quality.BITS, np.float32), 0.0)
trie = ppm.Trie(*ppm.count_grams([text[:20_000].encode()]), np.bincount(np.frombuffer(text[:20_000].encode(), np.uint8) + np.int64(1), minlength=1 << ppm.BITS))
trie.score(np.zeros(1, np.uint64))
def score(raw):
    for _, _, g, _ in ppm.gram_parts([raw], 1 << 18):
        trie.score(g)
run = {"shingles": lambda t: neardup.shingle_sets([t]), "quality": lambda t: model.score([t]), "grams": lambda t: [len(np.unique(g[ppm._real(g)], return_counts=True)[0]) for _, _, g, _ in ppm.gram_parts([t.encode().lower()], 1_000_000)], "score": lambda t: score(t.encode().lower())}[what]
run(text[:3_000_000])  # what is remembered for later texts
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
before = peak()
run(text)
print((peak() - before) / size, size)
"""


@pytest.mark.parametrize("what", ["shingles", "quality", "grams", "score"])
def test_memory_of_a_long_text(what):
    out = subprocess.run([sys.executable, "-c", SCRIPT, what], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert out.returncode == 0, out.stderr
    times, size = map(float, out.stdout.split())
    assert size > 30_000_000 and times < 10, times
