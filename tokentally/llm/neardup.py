"""Operator 8: near-duplicate documents by HyperMinHash.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Its
signature has 128 registers; each keeps, of a minimum hash, the number of
leading zeros (6 bits) and the ten bits after the leading one.  Sets of 256 and more
shingles are dealt to 128 buckets by their hashes' top bits; sets of up to 341,
which would leave many buckets empty, take the minimum under 128 permutations.
Two sets of similarity 0.75 differ in size by a third at most, so each such pair
shares a level.  Bands of four registers (64 bits as they are) give candidates; the
share of equal registers, corrected for chance collisions, estimates the
similarity; what may reach the threshold is verified on the full sets.

Equal sets are one class from the start.  Within a band's bucket, every class is first
compared with the bucket's smallest id only, which is linear in the
bucket's size.  Buckets that still hold several components after that are compared
in blocks of bounded size, across components only, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.components import components
from tokentally.llm.shared import drop_scratch, materialize, mix64, prepare, salted_join, word_hashes

WORDS, REGISTERS, ROWS, MANTISSA = 5, 128, 4, 10
BANDS = REGISTERS // ROWS
LARGE_FROM, SMALL_TO = 256, 341
PERCENT = 75
#: An estimate has a standard error of at most 0.0385 at 0.75; pairs 4.5 of them below are not verified.
LEAST_ESTIMATE = 0.75 - 4.5 * 0.0385
BLOCK = 256
#: Candidate ids up to this many are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
EMPTY, _NO_BAND = np.uint16(0xFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20240607)
_MULT = _RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words has its whole sequence, one without words nothing."""
    flat, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            c = flat[at : at + n]
            at += n
            if n >= WORDS:
                # A shingle takes its first word's place: a million at a time, so that a long text needs no other arrays of its length.
                for a in range(0, n - WORDS + 1, 1 << 20):
                    b = min(n - WORDS + 1, a + (1 << 20))
                    h = c[a:b] * _POWERS[WORDS - 1]
                    for k in range(1, WORDS):
                        h += c[a + k : b + k] * _POWERS[WORDS - 1 - k]
                    c[a:b] = mix64(h, 1)
                h = c[: n - WORDS + 1]
                h.sort()
                new = np.empty(len(h), dtype=bool)
                new[0] = True
                np.not_equal(h[1:], h[:-1], out=new[1:])
                out.append(h[new])
            elif n:
                out.append(np.array([xxhash.xxh64_intdigest(c.tobytes(), seed=n)], dtype=np.uint64))
            else:
                out.append(c)
    return out


def registers(v: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 64-bit minima."""
    m, e = np.frexp((v >> np.uint64(11)).astype(np.float64))
    return ((53 - e).astype(np.uint16) << np.uint16(MANTISSA)) | np.clip((2 * m - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)


def signature_small(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return registers((h[:, None] * _MULT + _ADD).min(axis=0))


def signature_large(h: np.ndarray) -> np.ndarray:
    """``h`` is sorted: a bucket's minimum is the first hash with its top bits."""
    at = np.searchsorted(h, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57))
    first = h[np.minimum(at, len(h) - 1)]
    full = (at < len(h)) & (first >> np.uint64(57) == np.arange(REGISTERS, dtype=np.uint64))
    return np.where(full, registers(first << np.uint64(7)), EMPTY)


def band_keys(signature: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of the bands: a band's four registers are its 64-bit key, mixed with its number; bands of empty buckets alone tell nothing and are left out."""
    bands = np.frombuffer(signature, dtype="<u8")
    seeds = np.arange(BANDS, dtype=np.uint64) + np.uint64(level * BANDS + 1)
    with np.errstate(over="ignore"):
        keys = mix64(bands + seeds * np.uint64(0x9E3779B97F4A7C15))
    told = np.flatnonzero(bands != _NO_BAND)
    return keys[told], told + level * BANDS


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How likely a register of unrelated sets is equal: both minima have the same leading zeros, and the mantissas agree."""
    k = np.arange(64)[:, None]
    share = lambda n: np.power(1 - 2.0 ** -(k + 1), n) - np.power(1 - 2.0**-k, n)
    return (share(n_a) * share(n_b)).sum(axis=0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Similarity from signatures (rows of registers), corrected for chance collisions."""
    told = (a != EMPTY) | (b != EMPTY)  # a bucket that is empty in both says nothing
    equal = ((a == b) & told).sum(axis=1) / np.maximum(told.sum(axis=1), 1)
    scale = np.where(large, REGISTERS, 1)
    lost = chance(np.maximum(n_a / scale, 1), np.maximum(n_b / scale, 1))
    return (equal - lost) / (1 - lost)


def _sign(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature_small(s).tobytes() if 0 < len(s) <= SMALL_TO else None for s in sets], pa.binary()),
                    pa.array([signature_large(s).tobytes() if len(s) >= LARGE_FROM else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "small", "large"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, small binary, large binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            for rep, small, large in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for level, s in enumerate((small, large)):
                    if s is not None:
                        k, n = band_keys(s, level)
                        keys.append(k)
                        numbers.append(n)
                        ids += [rep] * len(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(numbers).astype(np.int32)), pa.array(np.array(ids, np.int64))], names=["band", "number", "rep"])

    return reps.select("rep", "small", "large").mapInArrow(run, "band long, number int, rep long")


def _likely(f: pd.DataFrame) -> np.ndarray:
    """Which rows (n_a, small_a, large_a, and so with b) may reach the threshold; both must share a level."""
    out = np.zeros(len(f), dtype=bool)
    for name in ("small", "large"):
        at = np.flatnonzero((f[f"{name}_a"].notna() & f[f"{name}_b"].notna()).to_numpy())
        if len(at):
            own = f.iloc[at]
            a, b = (np.frombuffer(b"".join(own[f"{name}_{s}"]), dtype="<u2").reshape(-1, REGISTERS) for s in "ab")
            out[at] |= estimate(a, b, own["n_a"].to_numpy(float), own["n_b"].to_numpy(float), np.full(len(at), name == "large")) >= LEAST_ESTIMATE
    return out


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("small").alias(f"small_{s}"), F.col("large").alias(f"large_{s}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[_likely(f), ["a", "b"]]

    # A bucket's leader is in as many pairs as the bucket has classes.
    return salted_join(pairs, side("a"), "a", ["b"]).join(side("b"), "b").mapInPandas(run, "a long, b long")


def _short_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, short: the sorted distinct 32-bit hashes of the sets of some documents."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["rep", "short"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "rep long, short binary")


def _verified(pairs: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b; a written table) whose full sets reach the threshold; ``repeated``: whether some rows of ``docs`` share a doc_id, which hold the same set then."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if pairs.count() * 2 <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())], pa.binary())], names=["doc_id", "set"])

    held = docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, set binary")
    held = materialize(held.distinct() if repeated else held, "sets")
    side = lambda s: held.select(F.col("doc_id").alias(s), F.col("set").alias(f"set_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("a", "b", "set_a", "set_b"))
            keep = []
            for i in range(len(a)):
                s, t = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(m)

    out = materialize(salted_join(pairs, side("a"), "a", ["b"], rows=2_000).join(side("b"), "b").mapInArrow(run, "a long, b long"), "links")
    drop_scratch(docs.sparkSession, held)
    return out


def _across(collided: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of different components in one bucket that reach the threshold but for hash collisions.

    What the estimate lets through is compared by the sets' 32-bit hashes within the
    block; collisions can only raise that count, so no link is lost, and pairs below
    the threshold are never written.  A pair that shares several bands is compared
    in the first.

    In each bucket the largest component's classes need comparing with the others
    alone.  Both sides are cut into blocks of about BLOCK; each block of others meets each
    block of the largest component, and the others' blocks meet each other.  Where one
    component holds nearly all of a bucket, as in a large group of near copies, that is
    linear in the bucket's size.
    """
    own = collided.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("band", "number", "rep", F.coalesce("component", "rep").alias("comp"))
    per = own.groupBy("band", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("band", F.col("top.comp").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("main_blocks"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int").alias("other_blocks"))
    own = materialize(own.join(mixed, "band"), "mixed")
    short = _short_sets(own.select(F.col("rep").alias("doc_id")).distinct(), docs)
    cut = own.withColumn("is_main", F.col("comp") == F.col("main"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    # (p, q): block p of the largest component (or -1 - p of the others) with block q of the others.
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    at_main = F.transform(others, lambda q: F.struct(F.col("block").alias("p"), q.cast("int").alias("q")))
    at_other = F.concat(F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda p: F.struct(p.cast("int").alias("p"), F.col("block").alias("q"))), F.transform(others, lambda q: F.struct((-1 - F.least(q, F.col("block"))).cast("int").alias("p"), F.greatest(q, F.col("block")).cast("int").alias("q"))))
    dealt = cut.withColumn("to", F.explode(F.when(F.col("is_main"), at_main).otherwise(at_other))).select("band", "number", "to.p", "to.q", "rep", "comp", "block", "is_main").join(reps, "rep").join(short, "rep")
    n = int(collided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "band", "p", "q").sortWithinPartitions("band", "p", "q", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.column_stack([t.column(c).to_numpy() for c in ("band", "p", "q")])
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1  # the last group may go on in the next batch
            held = t.slice(last)
            if last:
                yield _compared(t.slice(0, last), key[:last])
        if held is not None and len(held):
            yield _compared(held, np.column_stack([held.column(c).to_numpy() for c in ("band", "p", "q")]))

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _compared(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    """Likely pairs of different components within each group of equal ``key``."""
    comp, block, main, rep = (t.column(c).to_numpy() for c in ("comp", "block", "is_main", "rep"))
    edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
    left, right = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i, j = np.triu_indices(b - a, 1)
        i, j = i + a, j + a
        p, q = int(key[a, 1]), int(key[a, 2])
        meet = main[i] != main[j] if p >= 0 else (block[i] != block[j]) | (-1 - p == q)
        some = meet & (comp[i] != comp[j])
        left.append(i[some])
        right.append(j[some])
    i, j = np.concatenate(left), np.concatenate(right)
    ok = np.zeros(len(i), dtype=bool)
    n, number = t.column("n").to_numpy().astype(float), t.column("number").to_numpy()
    for name in ("small", "large"):
        col = t.column(name).to_pylist()
        have = np.array([c is not None for c in col])
        at = np.cumsum(have) - 1
        sig = np.frombuffer(b"".join(c for c in col if c is not None), dtype="<u2").reshape(-1, REGISTERS)
        both = np.flatnonzero(have[i] & have[j])
        for k in range(0, len(both), 50_000):
            x, y = i[both[k : k + 50_000]], j[both[k : k + 50_000]]
            ok[both[k : k + 50_000]] |= estimate(sig[at[x]], sig[at[y]], n[x], n[y], np.full(len(x), name == "large")) >= LEAST_ESTIMATE
        at_level = np.flatnonzero(ok & (number[i] // BANDS == (name == "large")))
        if len(at_level):  # only in the first band that both share
            words = sig.view("<u8")
            x, y = words[at[i[at_level]]], words[at[j[at_level]]]
            ok[at_level] &= ((x == y) & (x != _NO_BAND)).argmax(axis=1) == number[i[at_level]] % BANDS
    sets = t.column("short").to_pylist()
    for k in np.flatnonzero(ok).tolist():
        x, y = (np.frombuffer(sets[r], dtype="<u4") for r in (i[k], j[k]))
        both = len(np.intersect1d(x, y, assume_unique=True))
        # Hashes that fall together within one set make it smaller: the full sizes stand in the bound, the lost ones are added.
        spare = int(n[i[k]]) - len(x) + int(n[j[k]]) - len(y)
        ok[k] = 100 * (both + spare) >= PERCENT * (n[i[k]] + n[j[k]] - both - spare)
    a, b = rep[i[ok]], rep[j[ok]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    A component's id is the smallest doc_id that links reach; kept marks the row that
    has it.  Null texts, empty ones and such without words have an empty set
    and stand alone; so do rows without doc_id (component_id null, kept true).
    Rows that share a doc_id count as one document, which links whatever any of them is near to.
    Further columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(_sign(docs), "signed")
    classes = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_key"], "left_semi").groupBy("doc_id", "set_key").agg(F.first("n_shingles").alias("n"), F.first("small").alias("small"), F.first("large").alias("large"), F.count("*").alias("copies"))
    reps = materialize(reps.withColumnRenamed("doc_id", "rep").drop("set_key"), "reps")
    repeated = not reps.where("copies > 1").isEmpty()
    reps = reps.drop("copies")
    bands = _bands(reps)
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1").select("band", "leader")
    collided = materialize(bands.join(buckets, "band"), "collided")
    first = collided.where("leader != rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = materialize(_estimated(first, reps), "pairs")
    links = _verified(first, docs, repeated)
    found = materialize(components(links), "components")
    again = materialize(_across(collided.select("band", "number", "rep"), found, reps, docs), "pairs")
    more = _verified(again, docs, repeated)
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)), "components")
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    # Only rows that are in a class are joined, the rest stand alone; a class of very many copies is dealt to several tasks.
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    light = signed.select("doc_id", "n_shingles", "set_key")
    out = salted_join(light.where(linked), named, "set_key", [F.rand(5)], "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(light.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group: that with the smallest doc_id.

    Rows that repeat its id and text are dropped but for one; rows with its id and
    another text stay, since they may be no copies.  Rows without doc_id stay, so do
    empty texts, each a document of its own.
    """
    result = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = docs.join(result, docs["doc_id"].cast("long") == result["__kept_id"]).dropDuplicates(["__kept_id", "text"]).drop("__kept_id")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
