from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tokentally.llm import spelling


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    """By dynamic programming: edit distance just 1."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] == 1


def brute_force(rows):
    n = plain_words(rows)
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, n[w], len(others))
    last = lambda w: last(out[w][0]) if out[w][0] else w
    return {w: (f, last(w), k, c, n[f] if f else None) for w, (f, k, c) in out.items()}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def mutate(w, rng):
    i, c = rng.randrange(len(w) + 1), rng.choice("abéÿÀ")
    return rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[: i - 1] + w[i:] if i else w])


@pytest.mark.parametrize(("automaton", "hot"), [(20_000, 50_000), (3, 2)])
def test_variants(spark, documents, monkeypatch, automaton, hot):
    monkeypatch.setattr(spelling, "AUTOMATON", automaton)
    monkeypatch.setattr(spelling, "HOT_HALF", hot)
    rng = random.Random(3)
    base = ["".join(rng.choices("abé", k=rng.randrange(5, 12))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "bbaaaaaa"]
    family = base + [mutate(w, rng) for w in base for _ in range(3)]
    family += [mutate(w, rng) for w in family]
    bag = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in family for _ in range(rng.choice([1, 4, 5, 6, 30, 160]))]
    rng.shuffle(bag)
    rows = [(i, rng.choice([" ", "-", "1", "Ж", "\U0001f600"]).join(bag[i * 40 : i * 40 + 40])) for i in range(len(bag) // 40 + 1)]
    rows += [(9001, None), (9002, ""), (9003, "short x"), (None, "nameless " * 9), (9004, "lengthy " * 300_000), (7, rows[7][1]), (9005, "z" * 70_000 + " " + ("z" * 70_000 + " ") * 5)]
    got = result(spelling.spelling_variants(documents(rows).repartition(5)))
    long = "z" * 70_000
    assert got.pop(long) == (None, long, 6, 0, None)
    want = brute_force([r for r in rows if r[0] != 9005])
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 30 and any(f and r != f for f, r, *_ in want.values())


def test_empty(spark, documents):
    assert spelling.spelling_variants(documents([])).count() == 0
    assert spelling.spelling_variants(documents([(1, None)])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_automaton():
    rng = random.Random(5)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 8))) for _ in range(300)})
    a = spelling.Automaton(words)
    assert [a.walk(a.root, 0, w)[1] for w in words] == list(range(len(words)))
    assert len(a.edges) < sum(len({w[i:] for w in words}) for i in range(1)) and a.walk(a.root, 0, b"abcabcabcabc") is None
    # Minimal: no two states accept the same rests.
    rests = {}
    for s in range(len(a.edges)):
        rests[s] = (a.final[s], *sorted((c, rests[t]) for c, (t, _) in a.edges[s].items()))
    assert len(set(rests.values())) == len(rests)
    for w in words[:80]:
        for exact in (0, len(w) // 2):
            assert {words[k] for k in a.with_one_error(w, exact)} - {w} == {x for x in words if near(w.decode(), x.decode()) and x[:exact] == w[:exact] and near(w[exact:].decode(), x[exact:].decode())}


def test_misspell():
    seed = zlib.crc32(b"7:")
    run = next(w for w in (b"caf\xe9%d" % i for i in range(5000)) if zlib.crc32(w.decode("latin-1").encode(), seed) % 199 == 0)
    h = zlib.crc32(b"7:" + run.decode("latin-1").encode())
    assert spelling.misspell(run, seed) == run[: h % len(run)] + run[h % len(run) + 1 :]
