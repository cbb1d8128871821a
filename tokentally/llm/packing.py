"""Operator 2: best-fit packing by minimum bin slack.

Minimum bin slack opens a bin with the longest piece left and fills the rest
with the fullest feasible combination of the lengths left, found by a
subset-sum dynamic program over a bitset; the combination is then removed.
Pieces of one length are interchangeable, so the plan is made on the histogram
of lengths (at most ``capacity`` rows, whatever the input).  A combination is
applied as often as its lengths last, thus each distinct combination uses up at
least one length and there are at most ``capacity`` of them.  The pieces take their
places by their rank within their length, computed in salted groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.shared import materialize, prepare
from tokentally.llm.tokens import encoder


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``: bitset subset-sum, traced back."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            chunk = min(chunk, left)
            new = (bits | bits << (length * chunk)) & mask
            if new != bits:
                steps.append((length, chunk, bits))
                bits = new
            left -= chunk
            chunk *= 2
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + chunk
            at -= length * chunk
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins each fills."""
    counts, out = {k: n for k, n in histogram.items() if n > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((used, times))
    return out


def places(made: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the run's first rank, the first bin it fills and the offset in the bin."""
    rows, taken, first_bin = [], {}, 0
    for used, times in made:
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                rank = taken.get(length, 0)
                rows.append((length, rank, first_bin, offset))
                taken[length] = rank + times
                offset += length
        first_bin += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "bin": a[:, 2], "offset": a[:, 3]}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, unsigned 32-bit, if kept) of each document's pieces.

    Only documents longer than ``capacity`` are cut; a null text is empty and has
    the end id alone.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows = []
            for d, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                data += end
                for i in range(0, len(data), step):
                    part = data[i : i + step]
                    rows.append((d, i // step, i // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if keep_ids else ()))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack the documents' token ids into as few sequences of at most ``capacity`` as minimum bin slack finds.

    Returns the pieces of token_pieces() with sequence_id and offset; a
    sequence's pieces lie side by side from offset 0.  Rows with equal doc_id, equal rows and such without
    doc_id are packed each for itself; null texts are empty documents; texts of
    any length are cut into pieces; pieces of one length are interchangeable; further
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # Each piece is numbered as it is written, so that equal rows, however many, are dealt to different salts.
    numbered = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    pieces = numbered.drop("row")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    made = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    # A length's ranks: salted groups of at most about 100,000 rows, each numbered for itself from where the groups before it end.
    salts = max(64, -(-total // 100_000))
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = salted.withColumn("own", own).join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("own") - 1).drop("own", "first", "salt", "row")
    schema = pieces.schema.simpleString()[7:-1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = made.value
        for f in frames:
            at = np.searchsorted(p["key"], (f["length"].to_numpy() << 44) + f["rank"].to_numpy(), side="right") - 1
            f["sequence_id"] = p["bin"][at] + f["rank"].to_numpy() - p["rank"][at]
            f["offset"] = p["offset"][at]
            yield f

    columns = [*pieces.columns, "rank"]
    return ranked.select(*columns).mapInPandas(place, f"{schema}, rank bigint, sequence_id bigint, offset bigint").drop("rank")
