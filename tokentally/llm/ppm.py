"""Operator 6: language-model scoring by prediction by partial matching (PPM).

Counts of every byte after each context of up to ``ORDER`` bytes form a trie.  A byte
that its longest known context has seen gets (count - 1/2) / total; else the
model escapes with (distinct / 2) / total (method D) and goes on in the context one
byte shorter, without the symbols that the longer one has seen
(symbol exclusion), down to a uniform choice among what is left of the 257
symbols.  The 257th symbol ends a document.  The trie is fixed once trained, so all
that a node needs (totals, exclusions, escapes) is worked out beforehand, and
scoring is table look-ups over whole batches.

Only the counts of the longest contexts are gathered (one row for each
distinct byte string of ORDER + 1); shorter contexts are sums of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.llm.shared import AT_ONCE, give_back, materialize, prepare, remainder, segment_sums, segments, word_hash_parts

ORDER, BITS, END, SYMBOLS = 5, 9, 257, 257
FOLDS, HELD_OUT = 10, 0
MASK = (1 << BITS) - 1
#: Rows of one broadcast; beyond it the tables are split and the documents scored once for each part.
LARGEST_WORDS, LARGEST_TRIE = 1 << 22, 1 << 22
#: Bytes that are scored at once; a longer document is scored whole.
_AT_ONCE = 1 << 18


class Lookup:
    """Open addressing over distinct 64-bit keys, probed for whole arrays at a time.  Slots hold rows only, keys stand once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = keys
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]
            won = free & (self.rows[at] == left)
            left, at = left[~won], (at[~won] + 1) & (len(self.rows) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._slot(keys)
        row = self.rows[at]  # at a free slot -1, the last key, which can't be the one that is sought
        hit = self.keys[row] == keys
        out = np.where(hit, row, np.int32(-1))
        left = np.flatnonzero(~hit & (row >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.rows) - 1)
            row = self.rows[at]
            hit = self.keys[row] == keys[left]
            out[left[hit]] = row[hit]
            on = ~hit & (row >= 0)
            left, at = left[on], at[on]
        return out


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one and the end symbol, each document led by ORDER zeros; and the documents' starts (plus the end)."""
    pad = b"\0" * ORDER
    joined = pad + (b"\0" + pad).join(texts) + b"\0"
    s = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.concatenate([[0], np.cumsum([len(t) + ORDER + 1 for t in texts])]).astype(np.int64)
    for k in range(ORDER):
        s[starts[:-1] + k] = 0
    s[starts[1:] - 1] = END
    return s, starts


def grams(s: np.ndarray) -> np.ndarray:
    """At each position from ORDER on, the last ORDER + 1 symbols, the latest in the lowest bits."""
    n = len(s) - ORDER
    out = s[:n].copy()
    for k in range(1, ORDER + 1):
        out <<= np.uint64(BITS)
        out |= s[k : n + k]
    return out


def gram_parts(raw: list[bytes], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, grams, starts of the texts' grams) of texts together, about ``size`` bytes at a time; of a long text, a piece at a time."""
    at = 0
    while at < len(raw):
        if len(raw[at]) > size:
            t = raw[at]
            for a in range(0, len(t), size):
                b = min(len(t), a + size)
                s = np.zeros(ORDER + b - a + (b == len(t)), dtype=np.uint64)
                lead = t[max(0, a - ORDER) : b]  # a piece begins with the context that comes before it
                s[ORDER - min(a, ORDER) : ORDER + b - a] = np.frombuffer(lead, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
                if b == len(t):
                    s[-1] = END
                g = grams(s)
                yield at, at + 1, g, np.array([0, len(g)])
            at += 1
            continue
        to, total = at, 0
        while to < len(raw) and len(raw[to]) <= size and (to == at or total + len(raw[to]) < size):
            total += len(raw[to])
            to += 1
        s, starts = symbols(raw[at:to])
        yield at, to, grams(s), np.maximum(starts - ORDER, 0)
        at = to


def _real(g: np.ndarray) -> np.ndarray:
    return (g & np.uint64(MASK)) != 0


def count_grams(texts: list[bytes], size: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for _, _, g, _ in gram_parts(texts, size):
        held.append(np.unique(g[_real(g)], return_counts=True))
        if len(held) > 4:
            held = [merge_counts(held)]
    return merge_counts(held)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, where they fit."""
    return counts.astype(np.int32) if not len(counts) or counts.max() < 1 << 31 else counts


class Trie:
    """Fixed code lengths (log10) of one part of the trie: the contexts that end with one of its suffixes, and the shorter ones above these."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, roots: np.ndarray, above: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        """``keys``: grams of ORDER + 1 symbols; ``roots``: how often each symbol occurs at all, in the whole corpus; ``above``: for each length of contexts that are split among parts their grams and counts in the whole corpus.  Only these travel; levels are built where they are used."""
        self.given, self.levels = (keys, counts, roots, above or {}), []

    def __getstate__(self) -> dict:
        return {"given": self.given, "levels": []}  # made on the driver, which never builds it

    def _build(self) -> None:
        keys, counts, roots, above = self.given
        self.given = None
        order = np.argsort(keys)
        tables = {ORDER: (keys[order], counts[order])}
        del keys, counts, order
        for k in range(ORDER - 1, 0, -1):
            short = tables[k + 1][0] & np.uint64((1 << BITS * (k + 1)) - 1)
            order = np.argsort(short)
            short = short[order]
            first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
            tables[k] = (short[first], np.add.reduceat(tables[k + 1][1][order], first) if len(first) else np.zeros(0, np.int64))
            if k in above:  # this part has some of these contexts' strings only
                whole, n = above[k]
                own = ~np.isin(tables[k][0] >> np.uint64(BITS), np.unique(whole >> np.uint64(BITS)))
                merged, counts = np.concatenate([tables[k][0][own], whole]), np.concatenate([tables[k][1][own], n])
                sort = np.argsort(merged)
                tables[k] = (merged[sort], counts[sort])
            del short, order, first
        seen = np.flatnonzero(roots).astype(np.uint64)
        tables[0] = (seen, roots[seen.astype(np.int64)].astype(np.int64))
        shorter = None
        for k in range(ORDER + 1):
            gram, n = tables.pop(k)
            ctx = gram >> np.uint64(BITS)  # sorted as the grams are: a context's symbols are a run
            new = np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, bool)
            ctx, at = ctx[new], np.cumsum(new, dtype=np.int32) - 1
            total = np.bincount(at, weights=n, minlength=len(ctx))
            distinct = np.bincount(at, minlength=len(ctx)).astype(np.float64)
            level = {"gram": Lookup(gram), "ctx": Lookup(ctx), "n": narrow(n), "of": at, "escape": np.log10(np.maximum(distinct, 1) / 2) - np.log10(np.maximum(total, 1)), "total": total, "distinct": distinct}
            level["first"] = np.log10(n - 0.5) - np.log10(np.maximum(total, 1))[at]
            if k:  # what is left in the shorter context without what this one has seen
                low = np.uint64((1 << BITS * k) - 1)
                row = shorter["gram"].find(gram & low)
                parent = shorter["of"][row]
                excluded = np.bincount(at, weights=shorter["n"][row], minlength=len(ctx))
                up = np.zeros(len(ctx), dtype=np.int64)
                up[at] = parent
                rest, kinds = shorter["total"][up] - excluded, shorter["distinct"][up] - distinct
                level["left"] = np.log10(np.maximum(rest, 1))
                level["left_escape"] = np.where(kinds > 0, np.log10(np.maximum(kinds, 1) / 2) - level["left"], 0.0)
            self.levels.append(level)
            shorter = level
        for level in self.levels:
            del level["total"], level["distinct"], level["of"]
        for level in self.levels:  # row -1 stands for what a level doesn't know, also where it is empty
            for name in ("n", "first", "escape", "left", "left_escape"):
                if name in level:
                    level[name] = np.append(level[name], level[name].dtype.type(1))
        self.uniform = -np.log10(max(1, SYMBOLS - len(seen)))
        give_back()

    def score(self, g: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after its context."""
        if not self.levels:
            self._build()
        top = self.levels[ORDER]
        row = top["gram"].find(g)
        out = top["first"][row]
        left = np.flatnonzero(row < 0)
        if len(left):
            out[left] = self._fall(g[left])
        return out

    def _fall(self, g: np.ndarray) -> np.ndarray:
        out, below = np.zeros(len(g)), np.full(len(g), -1, dtype=np.int64)  # below: the row of the context one longer, if it is known
        left = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            level, key = self.levels[k], g[left] & np.uint64((1 << BITS * (k + 1)) - 1)
            longer = self.levels[k + 1] if k < ORDER else None
            row, first = level["gram"].find(key), below < 0
            hit = row >= 0
            r, b = row[hit], below[hit]
            gain = level["first"][r]
            if longer:
                gain = np.where(b < 0, gain, np.log10(level["n"][r] - 0.5) - longer["left"][b])
            out[left[hit]] += gain
            left, key, below, first = left[~hit], key[~hit], below[~hit], first[~hit]
            ctx = level["ctx"].find(key >> np.uint64(BITS))
            known = ctx >= 0
            c, b = ctx[known], below[known]
            lost = level["escape"][c]
            if longer:
                lost = np.where(b < 0, lost, longer["left_escape"][b])
            out[left[known]] += lost
            below = ctx
        out[left] += self.uniform
        return out


class Words:
    """Counts of the training tokens whose hash is in [low, high], by their sorted hashes: no larger than what was broadcast."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int, n: int, v: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.append(narrow(counts)[order], np.int32(0))  # the last row stands for unknown words
        self.low, self.high, self.n, self.v = low, high, n, v

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for words of other parts."""
        known = np.zeros(len(hashes), dtype=bool)
        at = np.zeros(len(hashes), dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
        signed = hashes.view(np.int64)
        return np.where(known, at, np.where((signed >= self.low) & (signed <= self.high), len(self.keys), -1))

    def logs(self, rows: np.ndarray) -> np.ndarray:
        return np.where(rows < 0, 0.0, np.log10(self.counts[rows] + 0.1))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """kind, key, n over all rows of ``docs`` (text): kind 0 words by their hash (the end is key 0), 1 byte strings of ORDER + 1 symbols.

    Each task adds up what it reads and hands on its counts when they get many,
    so memory is bounded and the shuffle carries sums.
    """
    prepare(docs.sparkSession)

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + 100_000].astype(np.int64))], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # by kind: the sum so far, then parts to be added

        def merged(kind: int) -> None:
            if len(held[kind]) > 1:
                held[kind] = [merge_counts(held[kind])]

        def add(kind: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            held[kind].append(np.unique(values, return_counts=True))
            limit = (1_000_000, 3_000_000)[kind]
            if len(held[kind]) >= 8 or sum(len(k) for k, _ in held[kind]) > limit:
                merged(kind)
                if len(held[kind][0][0]) > limit:
                    yield from rows(kind, *held[kind].pop())

        for batch in batches:
            texts = batch.column(0).to_pylist()
            ends += len(texts)
            for hashes, _, _ in word_hash_parts(texts):
                yield from add(0, hashes)
            for _, _, g, _ in gram_parts([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], AT_ONCE):
                yield from add(1, g[_real(g)])
        for kind in (0, 1):
            merged(kind)
            for part in held[kind]:
                yield from rows(kind, *part)
        if ends:
            yield from rows(0, np.zeros(1, np.uint64), np.array([ends]))
        held.clear()
        give_back()  # the same process scores afterwards

    # The tasks' counts are sums already: they are dealt out as they are, without another table of them in each task's heap.
    return docs.select("text").mapInArrow(run, "kind int, key long, n long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", "n").toArrow()
    return t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()


def score_documents(docs: DataFrame, train: DataFrame, largest_words: int = LARGEST_WORDS, largest_trie: int = LARGEST_TRIE) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) under the model of ``train`` (text).

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score.  Texts are
    lower-cased (A-Z) first; a null text is empty and has the end alone.
    Without training rows every symbol has 1/257 and no token is known.
    Rows that repeat a doc_id are scored each for itself.  Words are known by
    a 64-bit hash.  A table of more than ``largest_words`` or ``largest_trie`` rows isn't broadcast
    whole: words split by hash, the trie by the contexts' last symbols (as many of them
    as it takes, see suffixes()).  The documents are scored for one part after the other, each
    written before the next is sent, and a document's parts add up.  Further columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = materialize(corpus_counts(train), "counts")
    words, strings = counts.where("kind = 0"), counts.where("kind = 1")
    symbol = F.col("key").bitwiseAND(MASK)
    w = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    v, n = w.v, w.n or 0
    leaves, above = suffixes(strings, largest_trie)
    roots = np.zeros(1 << BITS, dtype=np.int64)
    for r in strings.groupBy(symbol.alias("s")).agg(F.sum("n").alias("n")).collect():  # at most 257 rows
        roots[r.s] = r.n
    # Parts of at most so many rows: hash ranges of words, sets of last bytes of contexts.
    pieces = max(1, -(-v // largest_words))
    edges = [-(1 << 63) + (1 << 64) * i // pieces for i in range(pieces + 1)]
    groups: list[list[tuple[int, int]]] = [[]]
    size = 0
    for leaf, many in leaves:
        if size and size + many > largest_trie:
            groups.append([])
            size = 0
        groups[-1].append(leaf)
        size += many
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = max(len(groups), pieces)
    if passes > 1:
        ids = ids.withColumn("row", F.xxhash64("doc_id", "text"))
    scored = None
    for i in range(passes):
        part_words = part_trie = None
        if i < pieces:
            keys, k = _arrays(words.where((F.col("key") >= F.lit(edges[i])) & (F.col("key") <= F.lit(edges[i + 1] - 1))))
            part_words = Words(keys, k, edges[i], edges[i + 1] - 1, int(n), int(v))
        if i < len(groups):
            own_strings = strings
            if passes > 1:
                depths = {d: [s for k, s in groups[i] if k == d] for d, _ in groups[i]}
                own_strings = strings.where(reduce(Column.__or__, [_suffix(d).isin(s) for d, s in depths.items()], F.lit(False)))
            part_trie = (Trie(*_arrays(own_strings), roots, above), Shares(groups, i) if passes > 1 else None)
        shared = spark.sparkContext.broadcast((part_words, part_trie))
        own = _scored(ids, shared)
        if passes > 1:
            own = materialize(own, "scored")
            shared.destroy()
        scored = own if scored is None else scored.unionByName(own)
    if passes > 1:
        # Equal rows (same id and text) have equal sums: count them once a pass and put them back.
        sums = scored.groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("n_known", "base_score", "score", "one")], F.max("n_tokens").alias("n_tokens"))
        copies = F.col("one") / F.lit(passes)
        scored = sums.withColumn("copies", copies.cast("int")).select("doc_id", "n_tokens", (F.col("n_known") / copies).cast("long").alias("n_known"), (F.col("base_score") / copies).alias("base_score"), (F.col("score") / copies).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _suffix(depth: int) -> Column:
    """The last ``depth`` symbols of a string's context."""
    return F.shiftright("key", BITS).bitwiseAND((1 << BITS * depth) - 1)


def suffixes(strings: DataFrame, largest: int) -> tuple[list[tuple[tuple[int, int], int]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Suffixes of contexts, each as (number of symbols, symbols), with at most ``largest`` strings each, and the counts of the contexts that were split.

    The strings are split by the context's last symbol, where these are too many by
    the last two, and so on; a whole context has 257 strings at most.  The driver
    sees 258 sums and 257 counts for each suffix that is split, of which there are as many as ``largest``
    goes into the strings, times ORDER at most.  A split context's own counts
    go to every part, since parts hold some of its strings only.
    """
    leaves, above, heavy = [], {}, None
    for depth in range(1, ORDER + 1):
        own = strings if heavy is None else strings.where(_suffix(depth - 1).isin(heavy))
        sizes = [(r.s, r.n) for r in own.groupBy(_suffix(depth).alias("s")).agg(F.count("*").alias("n")).collect()]
        heavy = sorted(s for s, n in sizes if n > largest) if depth < ORDER else []
        leaves += [((depth, s), n) for s, n in sorted(sizes) if s not in set(heavy)]
        if not heavy:
            break
        rows = strings.where(_suffix(depth).isin(heavy)).groupBy(F.col("key").bitwiseAND((1 << BITS * (depth + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        above[depth] = _arrays(rows)
    return leaves, above


class Shares:
    """Which symbols one of several parts scores: those whose context ends with one of its suffixes; the first part also those whose context training never saw."""

    def __init__(self, groups: list[list[tuple[int, int]]], part: int):
        self.part, self.depths = part, []
        for depth in sorted({d for g in groups for d, _ in g}):
            pairs = sorted((s, k) for k, g in enumerate(groups) for d, s in g if d == depth)
            self.depths.append((depth, np.array([s for s, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs], dtype=np.int64)))

    def own(self, g: np.ndarray) -> np.ndarray:
        part = np.zeros(len(g), dtype=np.int64)
        for depth, known, of in self.depths:  # suffixes of different lengths exclude each other
            s = (g >> np.uint64(BITS)) & np.uint64((1 << BITS * depth) - 1)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            part = np.where(known[at] == s, of[at], part)
        return part == self.part


def _scored(ids: DataFrame, shared) -> DataFrame:
    key = ["row"] if "row" in ids.columns else []

    def base(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = shared.value[0]
        n, known, total = np.ones(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        for hashes, numbers, many in word_hash_parts(texts):
            np.add.at(n, numbers, many)
            if m is not None:
                row, starts = m.rows(hashes), segments(many)
                np.add.at(total, numbers, segment_sums(m.logs(row), starts))
                np.add.at(known, numbers, segment_sums((m.counts[row] * (row >= 0) > 0).astype(np.float64), starts))
        if m is None:
            return n, np.zeros(len(n), np.int64), np.zeros(len(n))
        if m.low <= 0 <= m.high:  # the part that has the end also takes every token's denominator
            end = m.rows(np.zeros(1, np.uint64))
            total += m.logs(end)[0] - n * np.log10(m.n + 0.1 * (m.v + 1))
            known += m.counts[end[0]] > 0
        return n, known.astype(np.int64), total

    def ppm(texts: list[str | None]) -> np.ndarray:
        if shared.value[1] is None:
            return np.zeros(len(texts))
        model, own = shared.value[1]
        out = np.zeros(len(texts))
        for at, to, g, starts in gram_parts([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], _AT_ONCE):
            real = _real(g)
            if own is not None:
                real &= own.own(g)
            score = np.zeros(len(g))
            score[real] = model.score(g[real])
            out[at:to] += segment_sums(score, starts)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, known, total = base(texts)
            arrays = [batch.column(0), pa.array(n), pa.array(known), pa.array(total), pa.array(ppm(texts))]
            names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            if key:
                arrays += [batch.column(2), pa.array(np.ones(len(n), np.int64))]
                names += ["row", "one"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ids.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double" + ", row long, one long" * bool(key))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Train on the rows outside the held-out fold, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has the end alone; rows that repeat are learnt from and scored each for itself, a null id counts as the
    empty text for its fold; texts are read whole; other columns, whatever their names, are left out; an empty table gives an
    empty result.
    """
    fold = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    scored = score_documents(docs, docs.where(~fold))
    return scored.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
