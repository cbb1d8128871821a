"""Operator 5: benchmark decontamination.

An item is found in a document where some run of the document's words is within
``floor(n * max_error)`` word edits (insertions, deletions, substitutions) of the
item's n words, so items of one to three words must occur as they are.  The CGK
random walk embeds a word sequence into 3n positions so
that a small edit distance becomes a small Hamming distance; tables that sample
positions of several walks collide for windows of the item's size with a
probability that repetition raises to the target recall.  Positions at which a walk
has run out of words tell nothing and never collide.  Every collision is
verified by the exact edit distance.

Windows need not be taken at every position: of any k + 1 words of an item, one stays
unedited under k edits, so windows are laid where one of its k + 1 rarest words
occurs; of an item of more than LONG words, one of its k + 1 first runs of RUN words that don't overlap, since
single words say little among so many.  This loses no match.  Where one edit at most is allowed, or where the simulated recall
misses its target even with MOST_TABLES tables, all these windows are verified.  Items and
windows are embedded with others of about their length, a bounded number of cells at a time, so a
long item costs what it is long, however many short ones there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.shared import lower_ascii, materialize, mix64, prepare, split_words, word_hashes

MAX_ERROR, TARGET_RECALL = 0.25, 0.999
WALKS, SAMPLED, MOST_TABLES = 4, 2, 512
#: Positions are sampled among the first so many for each word: later on most walks have run out of words.
REACH = 1.75
#: Items and their characters of one broadcast; more items are taken in several passes over the documents.
ITEMS_A_PASS, CHARS_A_PASS = 20_000, 20_000_000
#: Windows that are laid and compared at a time.
CHUNK = 1 << 16
#: Items of more words than LONG are anchored by runs of RUN words, which fit (k + 1) times into any of them.
LONG, RUN = 256, 3
#: Cells of embeddings and sampled positions that are held at a time.
CELLS = 1 << 21
_PAD = np.uint64(0x5BF0_3635_DCD1_A2B7)


def cgk(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of the windows words[start : start + length], as rows of 3 * the largest length.

    Step j writes the current word and goes on to the next one if the walk's
    random bit for (j, word) is set; beyond the window it writes a padding.
    """
    steps = 3 * int(lengths.max(initial=1))
    out = np.empty((len(starts), steps), dtype=np.uint64)
    at, end = starts.copy(), starts + lengths
    last = len(words) - 1
    odd = mix64(np.arange(steps, dtype=np.uint64), 77 + walk) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(steps):
            x = np.where(at < end, words[np.minimum(at, last)], _PAD)
            out[:, j] = x
            at += ((x * odd[j]) >> np.uint64(63)).astype(np.int64)
    return out


def sampled(embedded: np.ndarray, lengths: np.ndarray, walk: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each row and table, of SAMPLED positions among the first REACH * length of the embedding, and whether it tells something: none of the positions is padding."""
    u = np.random.default_rng(1000 + walk).random((tables, SAMPLED))
    at = np.minimum((u[None] * (REACH * lengths[:, None, None])).astype(np.int64), embedded.shape[1] - 1)
    picked = np.take_along_axis(embedded[:, None, :], at.reshape(len(at), 1, -1), axis=2).reshape(at.shape)
    key, told = np.zeros(at.shape[:2], dtype=np.uint64), np.ones(at.shape[:2], dtype=bool)
    for k in range(SAMPLED):
        key = mix64(key ^ picked[:, :, k], k + 1)
        told &= picked[:, :, k] != _PAD
    return key, told


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """The smallest edit distance of ``item`` to any run of ``text``, and where such a run first ends (Myers' bit vectors)."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


@dataclass
class Items:
    """Benchmark items as word hashes, their anchors, and their keys in every table."""

    ids: list[int]
    words: list[np.ndarray]
    allowed: list[int]
    tables: int = 0
    recall: float = 1.0
    #: Words of an anchor, the sorted anchors, and where those of number i stand: at places[first[i] : first[i + 1]] as (item, offset).
    anchors: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Whether an item's windows are verified without asking the tables.
    direct: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def build_items(rows: list[tuple[int, str]], max_error: float = MAX_ERROR, target_recall: float = TARGET_RECALL, most_tables: int = MOST_TABLES) -> Items:
    flat, counts = word_hashes([t for _, t in rows])
    ends = np.cumsum(counts).tolist()
    known = [(i, flat[b - n : b]) for (i, _), b, n in zip(rows, ends, counts.tolist(), strict=True) if n]
    items = Items([i for i, _ in known], [w for _, w in known], [int(len(w) * max_error + 1e-9) for _, w in known])
    if not known:
        return items
    text = {h: len(w) for h, w in zip(flat.tolist(), (w for _, t in rows for w in split_words(lower_ascii(t or ""))), strict=True)}
    common = Counter(int(w) for ws in items.words for w in set(ws.tolist()))
    found: dict[int, dict[int, list[tuple[int, int]]]] = {1: {}, RUN: {}}
    for n, ws in enumerate(items.words):
        k = items.allowed[n]
        if len(ws) > LONG:
            codes, order, width = runs_of(ws, RUN).tolist(), range(0, (k + 1) * RUN, RUN), RUN
        else:
            codes, width = ws.tolist(), 1
            order = sorted(range(len(ws)), key=lambda o: (common[codes[o]], -text[codes[o]], o))[: k + 1]
        for o in order:
            found[width].setdefault(codes[o], []).append((n, o))
    for width, at in found.items():
        if at:
            names = sorted(at)
            items.anchors.append((width, np.array(names, dtype=np.uint64), np.concatenate([[0], np.cumsum([len(at[c]) for c in names])]).astype(np.int64), np.array([p for c in names for p in at[c]], dtype=np.int64)))
    items.direct = np.array(items.allowed) <= 1
    if items.direct.all():
        return items
    items.tables, items.recall = tables_for(items, target_recall, most_tables)
    if items.recall < target_recall:
        items.direct[:] = True
    if not items.direct.all():
        items.keys = _keys(items, np.flatnonzero(~items.direct), items.tables)
    return items


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by its first one; the last ones, which have fewer, are hashed with what begins again."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        out = mix64(out ^ np.roll(words, -k), k + 11)
    return out


def _alike(lengths: np.ndarray, tables: int) -> Iterator[np.ndarray]:
    """Numbers of rows of about the same length (within a power of two), so many that CELLS cells bound their embeddings."""
    kind = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else ():
        size = max(1, CELLS // (3 * int(lengths[own].max()) + 4 * SAMPLED * tables))
        for part in range(0, len(own), size):
            yield own[part : part + size]


def _keys(items: Items, some: np.ndarray, tables: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each walk the keys of all items and whether they tell something; only ``some`` have any."""
    n = len(items.words)
    out = [(np.zeros((n if len(some) else 0, tables), dtype=np.uint64), np.zeros((n if len(some) else 0, tables), dtype=bool)) for _ in range(WALKS)]
    for own in _alike(np.array([len(items.words[i]) for i in some], dtype=np.int64), tables):
        which = some[own]
        flat = np.concatenate([items.words[i] for i in which])
        lengths = np.array([len(items.words[i]) for i in which], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for walk in range(WALKS):
            out[walk][0][which], out[walk][1][which] = sampled(cgk(flat, starts, lengths, walk), lengths, walk, tables)
    return out


def tables_for(items: Items, target_recall: float, most_tables: int = MOST_TABLES, trials: int = 400, seed: int = 3) -> tuple[int, float]:
    """Tables of each walk so that an item with all allowed edits is found with the target probability, by simulation, and the share that was found.

    Each trial edits an item at random as often as is allowed, puts it between words that
    occur nowhere else, and lays windows as search() does.  The least number of
    tables is taken with which the share of trials that collide nowhere is within the
    target, at most ``most_tables``.
    """
    rng = np.random.default_rng(seed)
    texts, meant = [], rng.choice(np.flatnonzero(~items.direct), trials)
    for n in meant.tolist():
        w = items.words[n].tolist()
        for _ in range(items.allowed[n]):
            kind, at = rng.integers(3), int(rng.integers(len(w)))
            new = int(rng.integers(1, 1 << 62))
            if kind == 0:
                w[at] = new
            elif kind == 1:
                w.insert(at, new)
            elif len(w) > 1:
                del w[at]
        size = len(items.words[n])
        texts.append(np.array([*rng.integers(1, 1 << 62, size).tolist(), *w, *rng.integers(1, 1 << 62, size).tolist()], dtype=np.uint64))
    codes = np.concatenate(texts)
    spans = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    # Keys for so many tables are made for the items of the trials alone.
    some, hit = np.unique(meant), np.zeros((trials, most_tables), dtype=bool)
    tried = Items([items.ids[i] for i in some], [items.words[i] for i in some], [items.allowed[i] for i in some])
    keys = _keys(tried, np.arange(len(some)), most_tables)
    for owner, which, first in _windows(items, codes, spans):
        own = which == meant[owner]
        owner, which, first = owner[own], np.searchsorted(some, which[own]), first[own]
        for part in range(0, len(owner), 2048):
            s = slice(part, part + 2048)
            np.logical_or.at(hit, owner[s], _equal(tried, keys, codes, spans, owner[s], which[s], first[s], most_tables))
    share = np.maximum.accumulate(hit, axis=1).mean(axis=0)
    return (int(np.argmax(share >= target_recall)) + 1 if share[-1] >= target_recall else most_tables), float(share[-1])


def _windows(items: Items, codes: np.ndarray, spans: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, first word) of every window, about CHUNK at a time: one for each (item, start) at an anchor; starts before the text are moved to its first word."""
    for width, anchors, starts, places in items.anchors:
        own = codes if width == 1 else runs_of(codes, width)
        near = np.minimum(np.searchsorted(anchors, own), len(anchors) - 1)
        hits = np.flatnonzero(anchors[near] == own)
        kind = near[hits]
        many = starts[kind + 1] - starts[kind]
        total = np.cumsum(many)
        at = 0
        while at < len(hits):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + CHUNK, side="right")))
            p, n = hits[at:to], many[at:to]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = places[np.repeat(starts[kind[at:to]], n) + inner]
            doc = np.repeat(np.searchsorted(spans, p, side="right") - 1, n)
            first = np.maximum(np.repeat(p, n) - place[:, 1], spans[doc])
            whole = np.unique(np.column_stack([doc, place[:, 0], first]), axis=0)
            yield whole[:, 0], whole[:, 1], whole[:, 2]
            at = to


def _equal(items: Items, keys: list, codes: np.ndarray, spans: np.ndarray, owner: np.ndarray, which: np.ndarray, first: np.ndarray, tables: int) -> np.ndarray:
    """For each window and table whether some walk's keys are equal; a window that leaves its text is padded by what CGK writes past its end."""
    length = np.array([len(w) for w in items.words], dtype=np.int64)[which]
    out = np.zeros((len(owner), tables), dtype=bool)
    for own in _alike(length, tables):
        inside = np.minimum(length[own], spans[owner[own] + 1] - first[own])
        for walk in range(WALKS):
            e = _padded(cgk(codes, first[own], inside, walk), 3 * int(length[own].max()))
            key, told = sampled(e, length[own], walk, tables)
            out[own] |= (key == keys[walk][0][which[own]]) & told & keys[walk][1][which[own]]
    return out


def search(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, distance, first word, number of words of the document's run) of every item found in each text."""
    codes, counts = word_hashes(texts)
    spans = np.concatenate([[0], np.cumsum(counts)])
    if not len(codes):
        return []
    lengths, edits = np.array([len(w) for w in items.words], dtype=np.int64), np.array(items.allowed, dtype=np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    bags: dict[int, frozenset] = {}
    for owner, which, first in _windows(items, codes, spans):
        # A run that matches has all but the allowed number of the item's words; most texts are too short for a long item.
        room = np.minimum(spans[owner + 1], first + lengths[which] + edits[which]) - np.maximum(spans[owner], first - edits[which])
        fits = room >= lengths[which] - edits[which]
        owner, which, first = owner[fits], which[fits], first[fits]
        hit = items.direct[which]
        asked = np.flatnonzero(~hit)
        for part in range(0, len(asked), 4096):
            s = asked[part : part + 4096]
            hit[s] = _equal(items, items.keys, codes, spans, owner[s], which[s], first[s], items.tables).any(axis=1)
        owner, which, first = owner[hit], which[hit], first[hit]
        low = np.maximum(spans[owner], first - edits[which])
        high = np.minimum(spans[owner + 1], first + lengths[which] + edits[which])
        for d, n, a, b in _merged(owner, which, low, high, edits):
            if (d, n) in best and best[d, n][0] == 0:
                continue
            k, seg = items.allowed[n], codes[a:b]
            if k == 0:  # as it is, or not at all
                w = items.words[n]
                if len(seg) == len(w) and (seg == w).all():
                    best[d, n] = (0, a - int(spans[d]), len(w))
                continue
            if n not in bags:
                bags[n] = frozenset(items.words[n].tolist())
            item, seg = items.words[n].tolist(), seg.tolist()
            have = bags[n].intersection(seg)
            if sum(w in have for w in item) < len(item) - k:  # each edit takes one of the item's words at most
                continue
            distance, end = best_match(item, seg)
            if distance <= k:
                back, size = best_match(item[::-1], seg[:end][::-1])  # the run's start: the shortest one that ends here
                found = (distance, a + end - size - int(spans[d]), size)
                best[d, n] = min(best.get((d, n), found), found)
    return [(d, n, *v) for (d, n), v in sorted(best.items())]


def _merged(owner: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, edits: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first, end) of what is to be verified: windows of an item that overlap as one, but where no edit is allowed."""
    held = None
    for d, n, a, b in zip(owner.tolist(), which.tolist(), low.tolist(), high.tolist(), strict=True):
        if held is not None and held[:2] == (d, n) and a <= held[3] and edits[n]:
            held = (d, n, held[2], max(b, held[3]))
        else:
            if held is not None:
                yield held
            held = (d, n, a, b)
    if held is not None:
        yield held


def _padded(e: np.ndarray, steps: int) -> np.ndarray:
    return e if e.shape[1] >= steps else np.concatenate([e, np.full((len(e), steps - e.shape[1]), _PAD)], axis=1)


def _passes(benchmark: DataFrame, items_a_pass: int) -> Iterator[tuple[Items, bool]]:
    """The items of each pass, and whether there are several; items are dealt by their hash."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = own.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, math.ceil(size.n / items_a_pass * 1.1), math.ceil((size.chars or 0) / CHARS_A_PASS * 1.1))
    for i in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()
        yield build_items(sorted((r.item_id, r.text) for r in rows)), parts > 1


def find_items(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """doc_id, item_id, distance, first_word, n_words: the best run of each item found in each row of ``docs``.

    Ties go to the earliest run.  Null and empty texts, null items and such without
    words and an empty benchmark find nothing; items that
    repeat an id and rows that repeat a doc_id are searched each for itself; a text of any
    length is searched whole; further columns are ignored.
    """
    prepare(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items, several in _passes(benchmark, items_a_pass):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        own = _found(ids, shared)
        if several:  # one pass's items at a time
            own = materialize(own, "found")
            shared.destroy()
        out = own if out is None else out.unionByName(own)
    return out


def _found(ids: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rows = search(held, batch.column(1).to_pylist()) if held.ids else []
            doc_ids = batch.column(0).to_pylist()
            cols = list(zip(*[(doc_ids[d], held.ids[n], dist, p, size) for d, n, dist, p, size in rows], strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "first_word", "n_words"])

    return ids.mapInArrow(run, T._parse_datatype_string("doc_id long, item_id long, distance int, first_word long, n_words long"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Null and empty texts stay, so do repeated rows of a clean text, each for itself; an empty
    benchmark keeps all rows.  With several passes over the items, what one keeps is written before the next.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for items, several in _passes(benchmark, items_a_pass):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                if held.ids:
                    keep[[r[0] for r in search(held, batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = materialize(docs, "clean")
            shared.destroy()
    return docs
