from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import DOCS
from tokentally.llm import divergence


def brute_force(rows, ranks=200):
    """Every group gives every term of its language, in Python's integers."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in rows}
    for t, lang, s in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        counts[lang, s].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(counts[g])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, own = shares(total), {s: shares(counts[lang, s]) for k, s in groups if k == lang}
        for s, p in own.items():
            pairs = [(-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o.encode()) for o, r in own.items() if o != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 2])
def test_divergence(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    rng = random.Random(8)
    words = ["".join(rng.choices("abÉß語", k=rng.randrange(1, 5))) for _ in range(60)] + ["\U0001f600", "", "A", "a"]
    rows = []
    for i in range(150):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(7)}"
        rows.append((rng.choice(["_", " ", "7", "\x7f", "\n"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 40))), rng.choice(["en", "de", None]), source))
    rows += [(None, "en", None), ("", None, ""), ("lonely words", "xx", "a"), ("others here", "xx", "b"), ("word " * 300_000 + "tail", "de", "long"), *[("same same", "yy", "z")] * 3, (None, "yy", "none"), ("a" * 3_000_000, "en", "s1")]
    df = spark.createDataFrame([(1, t, lang, s, None, "x", "y", "z") for t, lang, s in rows], DOCS)
    got = [tuple(r) for r in divergence.source_divergence(df.repartition(6), ranks=9).collect()]
    want = brute_force(rows, 9)
    assert sorted(got) == want and any(v > 0 for *_, v, _ in want)
    assert [r for r in want if r[0] == "xx"] == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_empty(spark, documents):
    df = divergence.source_divergence(documents([]))
    assert df.count() == 0 and df.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_large_counts(spark):
    """Shares are exact where 10 ** 9 times the count has more than 64 bits."""
    from pyspark.sql import functions as F

    n, total, v = 10**13 + 7, 3 * 10**13 + 1, 12_345
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + v)
