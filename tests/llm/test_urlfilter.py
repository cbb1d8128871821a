from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

from tokentally.llm import urlfilter
from tokentally.llm.urlfilter import BINS, RULES, UNIT, Shape


def parts(url):
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def rule(url, rules=RULES):
    host, path = parts(url)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return min(fit, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), default=None)


def cut(x):
    return max(min(math.floor(x + 1e-9), BINS - 1), 0)


def features(url, told, fold):
    host, path = parts(url)
    query = url.split("#")[0].partition("?")[2]
    n = len(url)
    e = math.log2(n) - sum(k * math.log2(k) for k in Counter(url).values()) / n if n else 0
    own = [n / 4, len(host) / 2, sum(x != "" for x in path.split("/")), 100 * sum(c in "0123456789" for c in url) / n / 3 if n else 0, e * 5, sum(x != "" for x in query.split("&")), host.count("."), host.count("-")]
    out = [cut(x) for x in own]
    known = []
    for k in (1, 2):
        name = ".".join(host.split(".")[-k:])
        same = [y for h, y, f in told if ".".join(h.split(".")[-k:]) == name and f != fold]
        known.append((len(same), sum(same)))
    return (*out, *[cut((b + 1) * 31 / (m + 2)) for m, b in known], cut(math.log2(known[1][0] + 1) * 2))


def brute_force(urls, shape):
    """Boosting row by row, with no table of sums."""
    fold = lambda u: ord(hashlib.md5(u.encode()).hexdigest()[0]) % 4
    told = [(parts(u)[0], int(rule(u)[2] == "block"), fold(u)) for u in urls if rule(u)]
    train = [(features(u, told, fold(u)), int(rule(u)[2] == "block")) for u in urls if rule(u)]
    every = {u: features(u, told, None) for u in set(urls)}
    if not train:
        return dict.fromkeys(every, 0)
    base = sum(y for _, y in train) * UNIT // len(train)
    at, score = [base] * len(train), dict.fromkeys(every, base)
    for _ in range(shape.trees):

        def grow(rows, depth):
            g = sum(train[i][1] * UNIT - at[i] for i in rows)
            best = None
            for f in range(11) if depth else ():
                for b in sorted({train[i][0][f] for i in rows})[:-1]:
                    left = [i for i in rows if train[i][0][f] <= b]
                    if min(len(left), len(rows) - len(left)) < shape.least:
                        continue
                    gl = sum(train[i][1] * UNIT - at[i] for i in left)
                    gain = gl * gl / len(left) + (g - gl) * (g - gl) / (len(rows) - len(left)) - g * g / len(rows)
                    if gain > 1 and (best is None or gain > best[0]):
                        best = (gain, f, b)
            if best is None:
                return g * shape.tenths // (len(rows) * 10)
            _, f, b = best
            return f, b, grow([i for i in rows if train[i][0][f] <= b], depth - 1), grow([i for i in rows if train[i][0][f] > b], depth - 1)

        tree = grow(range(len(train)), shape.depth)
        if not isinstance(tree, tuple):
            break

        def value(x, t):
            return value(x, t[2] if x[t[0]] <= t[1] else t[3]) if isinstance(t, tuple) else t

        at = [a + value(x, tree) for a, (x, _) in zip(at, train)]
        score = {u: s + value(every[u], tree) for u, s in score.items()}
    return score


def invented(rng, n):
    words = ["alpha", "Beta", "gam-ma", "d3lta", "x"]
    out = []
    for _ in range(n):
        top = rng.choice(["com", "net", "org", "example.com", "example.org", "example.net", "com"])
        path = "".join("/" + rng.choice(["en", "es", "fr", "de", "1", "a.html", "", "12345"]) for _ in range(rng.randrange(4)))
        query = rng.choice(["", "", "?a=1", "?a=1&b=2&&c", "#top", "?x#y?z"])
        out.append(f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choices(words, k=rng.randrange(1, 4)))}.{top}{path}{query}")
    return out


@pytest.mark.parametrize("shape", [Shape(), Shape(trees=3, depth=2, least=1, tenths=10)])
def test_judged(spark, shape):
    rng = random.Random(4)
    urls = invented(rng, 400)
    urls += [u.upper() for u in urls[:5]] + urls[:30] + ["", "no url", "http://", "http:///es/", "http://ORG/x", "http://xorg/", "http://example.org", "http://example.org/en/12?de", "ftp://é.example.org/es/É", "http://a.com?/fr/", "http://h.com/" + "q" * 200_000, "://com/de/"]
    rows = [(i, u, "<html>", "mine", 1.5) for i, u in enumerate(urls)] + [(None, urls[0], None, None, None), (9000, None, None, None, None), (3, urls[3], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, score double").repartition(5)
    got = urlfilter.judge_urls(pages, shape=shape).collect()
    assert len(got) == len(rows)
    score = brute_force([u or "" for _, u, *_ in rows], shape)
    want = []
    for page_id, url, *_ in rows:
        u = url or ""
        r = rule(u)
        want.append((page_id, *parts(u), r and r[0] + r[1], r[2] if r else "block" if 2 * score[u] >= UNIT else "allow", score[u]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    judged = Counter(v for _, _, _, r, v, _ in want if r is None)
    assert len(set(score.values())) > 3 and judged["allow"] and judged["block"]


def test_learns(spark):
    """What the rules block is learnt from the features."""
    rng = random.Random(1)
    urls = [f"http://h{i % 9}.org/{'en/1' if bad else 'en/2'}{rng.randrange(10**9) if bad else 'abc'}?{'&'.join('k=v' for _ in range(4 * bad))}" for i in range(400) for bad in [i % 2]]
    rules = [("org", "/en/2", "allow"), ("org", "/en/1", "block")]
    new = [u.replace("/en/", "/xx/") for u in urls]
    rows = urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string"), rules).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in rows) and sum(r.rule is None for r in rows) == 400


def test_nothing_to_learn(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [(r.verdict, r.rule, r.score) for r in urlfilter.judge_urls(pages).collect()] == [("allow", None, 0)] * 2
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_no_python(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(invented(random.Random(2), 50))], "page_id long, url string")
    plan = urlfilter.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
