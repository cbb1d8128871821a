"""Spelling variants: words at one inserted, deleted or replaced character from a far more frequent one.

Of two words that differ by one character, with the shorter one's length m and h = m // 2,
either the first h or the last h characters are equal.  So words meet by h and their first
h characters, and, reversed, by h and their last ones.  In each task the words that meet
are numbered by a minimal acyclic automaton, forward or backward: a word's half is walked
exactly, the rest is completed with just one error, and a path's number is the word's.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.divergence import byte_table, pieces
from tokentally.llm.shared import drop_scratch, materialize, prepare

#: Every so manieth run of letters (by its hash) is misspelt.
MISSPELT = 199
#: Words that a worker counts before it sends them on.
HELD_WORDS = 400_000
#: Words of an automaton, but for a half that more words share; these are dealt to several automata from HOT_HALF words on.
AUTOMATON, HOT_HALF = 20_000, 50_000
#: In Latin-1, the letters A-Z, a-z and U+00C0 to U+00FF.
_LETTERS = byte_table("".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)])))


def misspell(run: bytes, seed: int) -> bytes:
    """``run`` (Latin-1) without its character h % length, if MISSPELT divides h: the crc32 of the text before it, of which ``seed`` is the crc32, and of the run in UTF-8."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least_length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                seed, runs = zlib.crc32(f"{doc}:".encode()), Counter()
                for part in pieces((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS)):
                    runs.update(part)
                for run, n in runs.items():
                    if len(run) >= least_length:
                        word = misspell(run, seed)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield from out()
        yield from out()

    return count


def words_of(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: the runs of letters of all texts after misspelling, of at least so many characters and occurrences."""
    prepare(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return own.mapInArrow(_count(least_length), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted words (bytes), each of which has its place as its number.

    ``edges[state]`` leads by a byte to (state, words that come before those of that branch).
    """

    def __init__(self, words: list[bytes]):
        self.edges: list[dict[int, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple] = [([], [])]
        before = b""
        ends = [False]
        for w in words:
            same = next((i for i, (a, b) in enumerate(zip(before, w)) if a != b), min(len(before), len(w)))
            self._close(path, ends, same)
            for c in w[same:]:
                path[-1][0].append(c)
                path.append(([], []))
                ends.append(False)
            ends[-1] = True
            before = w
        self._close(path, ends, 0)
        self.root = self._state(path[0], ends[0])
        self._known.clear()

    def _close(self, path: list[tuple], ends: list[bool], depth: int) -> None:
        while len(path) - 1 > depth:
            target = self._state(path.pop(), ends.pop())
            path[-1][1].append(target)

    def _state(self, state: tuple[list[int], list[int]], final: bool) -> int:
        """The number of the state with these bytes, targets and finality; equal states are one."""
        key = (final, bytes(state[0]), tuple(state[1]))
        if key not in self._known:
            n, edges = int(final), {}
            for c, target in zip(*state, strict=True):
                edges[c] = (target, n)
                n += self._size[target]
            self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self._size.append(n)
        return self._known[key]

    def walk(self, state: int, number: int, rest: bytes) -> tuple[int, int] | None:
        """State and number after ``rest``, if there is such a path."""
        edges = self.edges
        for c in rest:
            to = edges[state].get(c)
            if to is None:
                return None
            state, number = to[0], number + to[1]
        return state, number

    def with_one_error(self, word: bytes, exact: int) -> set[int]:
        """Numbers of the words that share the first ``exact`` bytes with ``word`` and whose rest has just one byte more, less or replaced."""
        found: set[int] = set()
        at = self.walk(self.root, 0, word[:exact])
        for i in range(exact, len(word) + 1):
            if at is None:
                break
            state, number = at
            branches = [(t, number + k, word[i + 1 :]) for c, (t, k) in self.edges[state].items() if i < len(word) and c != word[i]]
            branches += [(t, number + k, word[i:]) for t, k in self.edges[state].values()]
            if i < len(word):
                branches.append((state, number, word[i + 1 :]))
            for s, k, rest in branches:
                end = self.walk(s, k, rest)
                if end is not None and self.final[end[0]]:
                    found.add(end[1])
            at = self.walk(state, number, word[i : i + 1])
        return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial results by word, from rows in order of (backward, h, part, word): words of a half are neighbours."""
    out: list[tuple] = []

    def search(group: list[list[tuple]], backward: bool, h: int) -> None:
        rows = [r for half in group for r in half]
        index = [(w, n) for w, n, own in rows if own]
        automaton = Automaton([w for w, _ in index])
        for w, _, _ in rows:
            n_near, best = 0, None
            for k in automaton.with_one_error(w, h):
                x, n = index[k]
                if x == w or min(len(x), len(w)) // 2 != h or backward and x[-h:] == w[-h:]:
                    continue  # other lengths meet by another h; equal first halves meet forward
                n_near += 1
                name = x[::-1] if backward else x
                if best is None or (-n, name) < best:
                    best = (-n, name)
            if n_near:
                out.append(((w[::-1] if backward else w).decode("latin-1"), n_near, -best[0], best[1].decode("latin-1")))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["word", "n_near", "best_n", "best"])

    group, size, run, half, last = [], 0, None, [], None

    def close_half() -> int:
        if len(half) < 2:
            return 0  # nothing shares this half
        group.append(list(half))
        return len(half)

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("backward", "h", "part", "half", "word", "n", "own")]
        for backward, h, part, key, word, n, own in zip(*columns, strict=True):
            if (backward, h, part, key) != last:
                size += close_half()
                half = []
                if group and (size >= AUTOMATON or (backward, h, part) != run):
                    search(group, run[0], run[1])
                    group, size = [], 0
                run, last = (backward, h, part), (backward, h, part, key)
            half.append((word.encode("latin-1"), n, own))
        if len(out) >= 20_000:
            yield batch()
    close_half()
    if group:
        search(group, run[0], run[1])
    yield batch()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: partial results, to be summed by word; words without a near one are absent."""
    n = F.length("word")
    sides = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    sides = sides.select("backward", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n", F.explode(F.array_distinct(F.array(F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")))).alias("h"))
    keyed = sides.withColumn("half", F.left("word", F.col("h")))
    keys = ["backward", "h", "half"]
    hot = materialize(keyed.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(HOT_HALF)).cast("int").alias("parts")).where("parts > 1"), "spelling-hot")
    parts = F.coalesce("parts", F.lit(1))
    placed = keyed.join(hot, keys, "left").withColumn("home", F.pmod(F.xxhash64("word"), parts).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("backward", "h", "half", "part", "word", "n", (F.col("home") == F.col("part")).alias("own"))
    return placed.repartition("backward", "h", "half", "part").sortWithinPartitions("backward", "h", "part", "word").mapInArrow(_near, "word string, n_near bigint, best_n bigint, best string")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of (word, root): roots that have a form themselves are followed to the last.

    Each step of a chain is at least five times as frequent, so ``most``, the largest
    count, bounds its length; each round doubles what is followed.
    """
    steps = max(1, int(math.log(max(most, 1), 5)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        done = materialize(forms.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        drop_scratch(forms.sparkSession, forms)
        forms = done
    return forms


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of ``least_length`` characters and ``least_count`` occurrences or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, with A-Z lower-cased, after
    misspell().  ``form`` is the near word of largest n (of equals the first in code-point order), if that n is ``ratio``
    times the word's or more; ``root`` is the last of the forms, the word itself without one.  n_near counts near
    words, whether or not one is the form.

    A null text has no words; a null id counts as the empty text, repeated rows count each.  Other
    columns are not looked at; an empty table gives an empty result.

    Words are counted in the tasks that read them.  A task holds the words that share a half, AUTOMATON or a
    few more; a half that more than HOT_HALF words share is dealt to several automata, each asked by all of these words.  At most
    about 64 * (2 * length + 1) words are near a word, so no form or root is a hot key.
    """
    spark = docs.sparkSession
    words = materialize(words_of(docs, least_length, least_count), "spelling-words")
    found = near_words(words).select("word", F.lit(None).cast("bigint").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")).alias("best"))
    whole = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best")).unionByName(found)
    judged = whole.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    far = -F.col("best.n") >= F.col("n") * ratio
    judged = materialize(judged.select("word", "n", "n_near", F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n")), "spelling-judged")
    most = judged.agg(F.max("n")).first()[0] or 1
    roots = _roots(materialize(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-forms"), most)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
