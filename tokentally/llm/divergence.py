"""Source divergence audit: how far the sources of a language are from each other, and which terms make a source.

A language's terms and its sources span a table that is nearly all zeros.  A pair of
sources therefore starts at its value for a term that neither has, times the number of
terms; only postings (term, source, count) change it:

* a term that one of the two has, by what it changes where the other has none.  That
  depends on its count alone, so it is summed over the counts' histogram;
* a term that both have, by what is then still missing.  These come from the postings'
  join by term, and go on only where they aren't zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.shared import materialize, prepare

#: Terms that a worker counts before it sends them on.
HELD_TERMS = 400_000
#: Sources of a language, or postings of a term, that one task joins with all others.
BLOCK = 256
_COUNTED = "lang string, source string, term binary, n bigint, docs bigint"


def byte_table(keep: str) -> bytes:
    """A translation of bytes for bytes.split(): A-Z to a-z, the characters of ``keep`` (below 256) as they are, others to spaces."""
    kept = {ord(c) for c in keep}
    return bytes(c + 32 if 65 <= c <= 90 else c if c in kept else 32 for c in range(256))


#: Letters and all bytes of characters above U+007F.
_TERM_BYTES = byte_table("".join(map(chr, [*range(97, 123), *range(128, 256)])))


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` between spaces, a megabyte at a time, so that a long text doesn't become one long list."""
    at = 0
    while at < len(data):
        to = len(data) if len(data) - at <= size else data.find(b" ", at + size)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]  # the null term says that the group occurs
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        lang, source = b.column("lang").to_pylist(), b.column("source").to_pylist()
        for i, text in enumerate(pc.cast(b.column("text"), pa.binary())):
            at = held.get((lang[i], source[i]))
            if at is None:
                at = held[lang[i], source[i]] = (Counter(), Counter())
                size += 1
            n, docs = at
            before, seen = len(n), set()
            for words in pieces(text.as_py().translate(_TERM_BYTES)):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > HELD_TERMS:
                yield from out()
                size = 0
    yield from out()


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10 ** 9 (n + 1) / (total + v)), exactly."""
    d = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * d(n + 1), d(total + v)) + 1


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, source, term, n, lang_n, sources (that have the term), first (one row of each term) of the terms that ``least_docs`` of a language's rows hold; a row without term for each group that occurs."""
    prepare(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(*map(empty, ("text", "lang", "source"))).mapInArrow(_count, _COUNTED)
    sums = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    whole = sums.withColumn("df", F.sum("docs").over(w)).withColumn("lang_n", F.sum("n").over(w)).withColumn("sources", F.count("*").over(w)).withColumn("first", F.row_number().over(w.orderBy("source")) == 1)
    return whole.where(F.col("term").isNull() | (F.col("df") >= least_docs)).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "sources", "first")


def _groups(counts: DataFrame) -> DataFrame:
    """lang, source, gid, total, v, lang_total, p0 (a source's share of a term that it lacks; null without terms), parts."""
    known = F.col("term").isNotNull()
    langs = counts.groupBy("lang").agg(F.sum(F.when(known & F.col("first"), 1).otherwise(0)).alias("v"), F.sum("n").alias("lang_total"), F.ceil(F.count_if(~known) / F.lit(BLOCK)).cast("int").alias("parts"))
    sources = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    g = sources.join(langs, "lang").withColumn("gid", F.monotonically_increasing_id())
    return g.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))))


def _pair_values(counts: DataFrame, groups: DataFrame, postings: DataFrame) -> DataFrame:
    """a, b, value of all ordered pairs of sources of a language."""
    dealt = lambda df, *by: df.withColumn("part", F.pmod(F.xxhash64(*by), "parts"))
    copied = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    g = groups.select("lang", "gid", "p0", "v", "parts")
    other = copied(g).select("lang", "part", F.col("gid").alias("b"), F.col("p0").alias("b0"))
    f = _distance
    base = dealt(g, "gid").join(other, ["lang", "part"]).where("gid != b").select(F.col("gid").alias("a"), "b", F.when(F.col("v") > 0, F.col("v") * f(F.col("p0"), F.col("b0"))).otherwise(F.lit(0)).alias("value"))
    # Terms of one source: how many of each count.
    p, p0, q, q0 = F.col("p"), F.col("p0"), F.col("q"), F.col("b0")
    histogram = postings.groupBy("lang", "gid", "p", "p0", "lang_parts").agg(F.count("*").alias("m"))
    alone = dealt(histogram.withColumnRenamed("lang_parts", "parts"), "gid", "p").join(other, ["lang", "part"]).where("gid != b")
    alone = alone.groupBy(F.col("gid").alias("a"), "b").agg(F.sum(F.col("m") * (f(p, q0) - f(p0, q0))).alias("ab"), F.sum(F.col("m") * (f(q0, p) - f(q0, p0))).alias("ba"))
    # Terms of both.
    left = dealt(postings, "gid").select("lang", "term", "part", "gid", "p", "p0")
    right = copied(postings).select("lang", "term", "part", F.col("gid").alias("b"), F.col("p").alias("q"), F.col("p0").alias("b0"))
    both = left.join(right, ["lang", "term", "part"]).where("gid < b")
    both = both.select(F.col("gid").alias("a"), "b", (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("ab"), (f(q, p) - f(q0, p) - f(q, p0) + f(q0, p0)).alias("ba"))
    both = both.where("ab != 0 OR ba != 0").groupBy("a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    turned = alone.unionByName(both).select(F.explode(F.array(F.struct("a", "b", F.col("ab").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value")))).alias("x")).select("x.*")
    return base.unionByName(turned).groupBy("a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: every other source of the language, with the sum over the language's terms
    of floor((p - q) ** 2 / q), p and q being the two sources' smoothed shares in
    billionths; ``term``: the ``ranks`` terms of the source whose share is most above the
    language's.  Ranks are by value, largest first, then by item in order of bytes.

    A null text, language or source counts as the empty one.  Terms are runs of letters
    and of characters above U+007F; only A-Z are lower-cased; texts are read whole.  A
    term is kept if ``least_docs`` rows of its language hold it, also if these rows are
    equal or share an id.  A group without kept terms has pairs all the same; without any kept term
    in the language their value is 0.  Other columns are not looked at; an empty table gives an empty result.

    A third of the documents in one source are counted in the tasks that read them; what is
    shuffled has a row for each term and source of a task.  A term of many sources and a
    language of many sources are dealt to several tasks.
    """
    counts = materialize(term_counts(docs, least_docs), "divergence-counts")
    groups = materialize(_groups(counts), "divergence-groups")
    own = groups.select("lang", "source", "gid", "total", "v", "lang_total", "p0", F.col("parts").alias("lang_parts"))
    postings = counts.where("term IS NOT NULL").join(own, ["lang", "source"])
    postings = postings.withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).withColumn("parts", F.ceil(F.col("sources") / F.lit(BLOCK)).cast("int"))
    pairs = _pair_values(counts, groups, postings.drop("q"))
    name = lambda a, b: groups.select(F.col("gid").alias(a), F.col("source").alias(b), "lang")
    pairs = pairs.join(name("a", "source"), "a").join(name("b", "item").drop("lang"), "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(top)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) AS d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) AS s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS BIGINT) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
