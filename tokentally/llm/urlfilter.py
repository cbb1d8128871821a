"""URL filters: rules on hosts and paths, and for all other URLs gradient-boosted trees on lexical features.

The trees learn from the URLs that a rule decides.  Each tree fits the residuals of those
before it (least-squares boosting) on features in 32 bins; residuals are whole millionths, so
sums don't depend on the order of rows and a model is the same on any cluster.  What is
learnt from is summed up by the features' bins first; a tree's level is one grouping of
that table, of which the driver sees a row for each node, feature and bin.  Everything is
a column expression or a grouping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.llm.shared import materialize, salted_join

#: (host, path, verdict): the rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A residual of one.
UNIT = 1_000_000
BINS, FOLDS = 32, 4
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix_blocked", "domain_blocked", "domain_known")


@dataclass(frozen=True)
class Shape:
    """Trees, levels of splits in each, least weight of a leaf, and how much of a leaf's mean residual is taken (in tenths)."""

    trees: int = 8
    depth: int = 3
    least: int = 5
    tenths: int = 4


# Parts of a URL.


def lower_letters(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a text that isn't null: both empty without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return lower_letters(host), F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits (of equally long ones the first in code-point order), null without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


# Features, each 0 to 31.


def entropy(text: Column) -> Column:
    """Bits a character, from runs of the sorted characters."""
    bits = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.when(a["c"] == x, F.struct(x.alias("c"), (a["k"] + 1.0).alias("k"), a["s"].alias("s"))).otherwise(F.struct(x.alias("c"), F.lit(1.0).alias("k"), (a["s"] + bits(a["k"])).alias("s")))
    total = F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda x: x != "")), start, step, lambda a: a["s"] + bits(a["k"]))
    n = F.length(text)
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))


def _bin(c: Column) -> Column:
    return F.greatest(F.least(F.floor(c + F.lit(1e-9)), F.lit(BINS - 1)), F.lit(0)).cast("int")


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The bins that a URL has by itself."""
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    parameters = F.size(F.filter(F.split(query, "&"), lambda x: x != ""))
    share = F.when(F.length(url) > 0, F.lit(100.0) * count(url, "[0-9]") / F.length(url)).otherwise(F.lit(0.0))
    return [_bin(F.length(url) / 4), _bin(F.length(host) / 2), _bin(depth.cast("double")), _bin(share / 3), _bin(entropy(url) * 5), _bin(parameters.cast("double")), _bin(count(host, "[.]").cast("double")), _bin(count(host, "-").cast("double"))]


def fold_of(url: Column) -> Column:
    """0 to 3, by the first digit of the URL's MD5."""
    return F.pmod(F.ascii(F.substring(F.md5(url.cast("binary")), 1, 1)), F.lit(FOLDS))


def split_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, told (the rule's verdict), domain and suffix (the host's last two labels and last one), bins (lexical)."""
    own = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    own = own.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    return own.select("*", rule.alias("rule"), told.alias("told"), last_labels(F.col("host"), 2).alias("domain"), last_labels(F.col("host"), 1).alias("suffix"), F.array(*lexical(F.col("url"), F.col("host"), F.col("path"))).alias("bins"))


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """domain, n0, b0, n1, ... and sn0, sb0, ...: how many URLs of each fold a rule decided, and how many it blocked, by domain and by suffix.  Every domain that occurs has a row."""
    sums = []
    for k in range(FOLDS):
        own = F.col("told").isNotNull() & (fold_of(F.col("url")) == k)
        sums += [F.count_if(own).alias(f"n{k}"), F.count_if(own & (F.col("told") == "block")).alias(f"b{k}")]
    domains = materialize(urls.groupBy("domain", "suffix").agg(*sums), "url-domains")
    counts = [f"{x}{k}" for k in range(FOLDS) for x in "nb"]
    suffixes = domains.groupBy("suffix").agg(*[F.sum(c).alias("s" + c) for c in counts])
    return materialize(salted_join(domains, suffixes, "suffix", ["domain"]).drop("suffix"), "url-suffixes")


def _known_bins(fold: Column | None) -> list[Column]:
    """Shares blocked and the count known, in bins; for a URL that is learnt from without those of its own fold."""

    def total(x: str) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(FOLDS):
            c = F.coalesce(F.col(f"{x}{k}"), F.lit(0))
            out = out + (c if fold is None else F.when(fold == k, F.lit(0)).otherwise(c))
        return out

    share = lambda n, b: _bin((total(b) + 1) * (BINS - 1) / (total(n) + 2))
    return [share("sn", "sb"), share("n", "b"), _bin(F.log2((total("n") + 1).cast("double")) * 2)]


# Trees.


@dataclass
class Tree:
    """Nodes numbered 1, then 2 k and 2 k + 1: splits (feature, largest bin of the left side), and leaves' values in millionths."""

    splits: dict[int, tuple[int, int]]
    leaves: dict[int, int]

    def node(self, bins: Column) -> Column:
        """The leaf's number."""

        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(k)
            feature, cut = self.splits[k]
            return F.when(bins[feature] <= cut, at(2 * k)).otherwise(at(2 * k + 1))

        return at(1)

    def value(self, bins: Column) -> Column:
        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(self.leaves.get(k, 0)).cast("bigint")
            feature, cut = self.splits[k]
            return F.when(bins[feature] <= cut, at(2 * k)).otherwise(at(2 * k + 1))

        return at(1)


@dataclass
class Model:
    base: int
    trees: list[Tree]

    def score(self, bins: Column) -> Column:
        """Millionths: 0 for allowed, UNIT for blocked URLs."""
        out = F.lit(self.base).cast("bigint")
        for t in self.trees:
            out = out + t.value(bins)
        return out


def best_splits(rows: list[tuple[int, int, int, int, int]], least: int) -> dict[int, tuple[int, int]]:
    """For each node the split that explains most, from (node, feature, bin, weight, sum of residuals); of equal ones the smallest feature and bin."""
    by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for node, feature, b, w, g in rows:
        by.setdefault((node, feature), []).append((b, w, g))
    best: dict[int, tuple[float, int, int]] = {}
    for (node, feature), bins in sorted(by.items()):
        n, total = sum(w for _, w, _ in bins), sum(g for _, _, g in bins)
        left, g_left = 0, 0
        for b, w, g in sorted(bins)[:-1]:
            left, g_left = left + w, g_left + g
            if left < least or n - left < least:
                continue
            g_right = total - g_left
            gain = float(g_left) * g_left / left + float(g_right) * g_right / (n - left) - float(total) * total / n
            if gain > 1e-6 * UNIT and (node not in best or gain > best[node][0]):
                best[node] = (gain, feature, b)
    return {k: (f, b) for k, (_, f, b) in best.items()}


def fit(weighted: DataFrame, shape: Shape) -> Model:
    """A model from (bins, y, w): labels 0 and 1 with their weights.  Without rows everything scores 0."""
    n, ones = weighted.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    model = Model((ones or 0) * UNIT // n if n else 0, [])
    bins, residual = F.col("bins"), lambda: F.col("y") * F.lit(UNIT).cast("bigint") - model.score(F.col("bins"))
    for _ in range(shape.trees if n else 0):
        tree, open_nodes = Tree({}, {}), [1]
        own = weighted.select("bins", "w", (F.col("w") * residual()).alias("g"))
        for _ in range(shape.depth):
            at = own.select(tree.node(bins).alias("node"), "w", "g", F.posexplode("bins").alias("feature", "bin")).where(F.col("node").isin(open_nodes))
            found = best_splits([tuple(r) for r in at.groupBy("node", "feature", "bin").agg(F.sum("w"), F.sum("g")).collect()], shape.least)
            tree.splits.update(found)
            open_nodes = [x for k in found for x in (2 * k, 2 * k + 1)]
            if not open_nodes:
                break
        sums = own.groupBy(tree.node(bins).alias("node")).agg(F.sum("g").alias("g"), F.sum("w").alias("w")).collect()
        tree.leaves = {r.node: r.g * shape.tenths // (r.w * 10) for r in sums}
        if not tree.splits:
            break
        model.trees.append(tree)
    return model


def training_table(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    """bins, y, w: the URLs that a rule decides, summed up by their features."""
    told = salted_join(urls.where("told IS NOT NULL").select("url", "domain", "bins", "told"), statistics, "domain", ["url"])
    fold = fold_of(F.col("url"))
    bins = F.concat("bins", F.array(*_known_bins(fold)))
    return told.select(bins.alias("bins"), F.when(F.col("told") == "block", 1).otherwise(0).cast("bigint").alias("y")).groupBy("bins", "y").agg(F.count("*").alias("w"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, shape: Shape | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with
    the rule's; the longest decides.  Without one the trees do: ``block`` from a score of half a
    UNIT on.  ``score`` is the trees' for all rows, in millionths.

    A null URL, or one without ``://``, has an empty host and path; it is judged by the trees.  Null
    and repeated page_ids are rows like others; other columns are not looked at.  If
    no rule fits any URL, there is nothing to learn from and all are allowed.  An empty table gives an
    empty result.  Rules are a list that someone writes: each is a part of the expression.

    Hosts' counts are summed up before the shuffle, and joined by domain in several tasks
    where a domain has very many pages; the text of a page isn't read.
    """
    urls = split_urls(pages, RULES if rules is None else rules)
    statistics = suffix_statistics(urls)
    model = fit(materialize(training_table(urls, statistics), "url-training"), shape or Shape())
    every = salted_join(urls.drop("bins"), statistics, "domain", ["url"], "left")
    bins = F.concat(F.array(*lexical(F.col("url"), F.col("host"), F.col("path"))), F.array(*_known_bins(None)))
    scored = every.withColumn("bins", bins).withColumn("score", model.score(F.col("bins")))
    judged = F.when(F.col("score") * 2 >= UNIT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("told", judged).alias("verdict"), "score")

