"""Deduplication as a stream: what each batch adds to the kept records and takes back from them."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokentally.operators.dedup import best_records, total_tokens
from tokentally.schema import ORDER

_TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")
#: So many requests of a message, with its side-chain record, are one entry of state, read and written at once; further ones have an entry each.
NEAR = 64
#: Where transformWithState keeps its state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestRecords(StatefulProcessor):
    """A message's kept records: its requests' main ones, and its side-chain one; a timer drops all.

    State costs a round trip for each access, so what most messages have is read and written as one value.

    The rules are those of operators.dedup.best_records().
    """

    def __init__(self, record: T.StructType, order: tuple[str, ...], keep_ms: int, time: str):
        self.record, self.order, self.keep_ms, self.time = record, order, keep_ms, time
        self.names = record.names
        self.out = Row(*record.names, "change")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.main = handle.getMapState("main", T.StructType([T.StructField("rid", T.StringType())]), self.record)
        self.near = handle.getValueState("near", T.StructType([T.StructField("held", T.BinaryType())]))
        self.until = handle.getValueState("until", T.StructType([T.StructField("ms", T.LongType())]))

    def _rank(self, r: tuple) -> tuple:
        d = dict(zip(self.names, r, strict=True))
        return (sum(d.get(c) or 0 for c in _TOKENS), d.get("speed") is not None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at = {c: i for i, c in enumerate(self.names)}
        every = list(rows)
        new = sorted((tuple(r[c] for c in self.names) for r in every), key=lambda r: tuple((r[at[c]] is not None, r[at[c]]) for c in self.order))
        if key[0].startswith("\0"):  # no message id: all stay, nothing is remembered
            yield from (self.out(*r, 1) for r in new)
            return
        found = self.near.get()
        near, had, more = pickle.loads(bytes(found[0])) if found is not None else ({}, None, False)
        was = (dict(near), had, more)
        before: dict[str, tuple | None] = {}  # main records of the requests at hand, as they were
        now: dict[str, tuple | None] = {}

        def main(rid: str) -> tuple | None:
            if rid not in now:
                held = near.get(rid)
                if held is None and more:
                    held = self.main.getValue((rid,))
                before[rid] = now[rid] = tuple(held) if held is not None else None
            return now[rid]

        side = had
        for r in new:
            rid = r[at["request_id"]] or ""
            held = main(rid)
            if not r[at["is_sidechain"]]:
                if held is None or self._rank(r) > self._rank(held):
                    now[rid] = r
                if held is None and side is not None and (side[at["request_id"]] or "") == rid:
                    side = None
            elif held is None and (side is None or self._rank(r) > self._rank(side)):
                side = r
        for rid, r in now.items():
            if r is not None and r != before[rid]:
                if rid in near or (before[rid] is None and len(near) < NEAR):
                    near[rid] = r
                else:
                    self.main.updateValue((rid,), r)
                    more = True
        if (near, side, more) != was:
            self.near.update((pickle.dumps((near, side, more)),))
        times = [int(r[self.time].timestamp() * 1000) for r in every if r[self.time] is not None]
        if times:
            ms = max(times) + self.keep_ms
            old = self.until.get()
            old = old[0] if old is not None else None
            if old is None or ms > old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(ms)
                self.until.update((ms,))
        for old, kept in [*((before[k], now[k]) for k in now), (had, side)]:
            if old != kept:
                if old is not None:
                    yield self.out(*old, -1)
                if kept is not None:
                    yield self.out(*kept, 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.main, self.near, self.until):
            if state.exists():
                state.clear()
        return iter([])

    def close(self) -> None:
        pass


def best_changes(stream: DataFrame, order: tuple[str, ...] = ORDER, watermark: str | None = "1 day", keep_days: float = 1.0) -> DataFrame:
    """``stream`` (canonical records) with ``change``: 1 for a record that is kept from now on, -1 for one that no longer is.

    Over all batches, what has a sum of 1 is what operators.dedup.best_records() keeps of the
    same rows in the same order (``order`` within a batch).  Append mode.  A message's
    state goes when the watermark is ``keep_days`` past its last record, and what lies behind the watermark is dropped.
    Without a watermark no row is ever dropped, and state goes ``keep_days`` after a message's last record was
    read.  What comes later is a message of its own.
    """
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    place = F.concat_ws(":", F.lit("\0"), *[F.col(c).cast("string") for c in order])
    timed = stream.withWatermark("ts", watermark) if watermark else stream.withColumn("_read", F.current_timestamp()).withWatermark("_read", "1 second")
    keyed = timed.withColumn("_key", F.coalesce(F.nullif("message_id", F.lit("")), place))
    out = T.StructType([*stream.schema.fields, T.StructField("change", T.IntegerType())])
    processor = BestRecords(T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields]), order, int(keep_days * 86_400_000), "ts" if watermark else "_read")
    return keyed.groupBy("_key").transformWithState(processor, out, "append", "eventTime")


def fold_batch(new: DataFrame, kept: DataFrame | None, path: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """What a batch's records do to the ``kept`` ones, by the rules of best_changes() but as one table after another, without Python.

    ``new`` has canonical columns and read_at; ``kept`` has the same, and at most one main record for each request of a message and one
    side-chain one, as results where ``change`` is not -1 have.  The result is written to ``path`` and read from there:
    the records with ``change``, 1 or -1 as in best_changes(), 0 for one that stays.  There read_at is the message's last, and ``order``
    may be null, since what was kept before precedes all that is new.

    ``new`` is evaluated once.  One shuffle by message and one sort tell a request's best main record.  A message that has
    side chains is written with all its records, and best_records() goes on from there.
    """
    rows = new.withColumn("_old", F.lit(False))
    if kept is not None:
        rows = kept.select(*new.columns, F.lit(True).alias("_old")).unionByName(rows)
    named = F.coalesce(F.col("message_id") != "", F.lit(False))
    place = F.concat_ws(":", F.lit("\0"), *[F.col(c).cast("string") for c in order])
    request, side = F.coalesce("request_id", F.lit("")), F.coalesce("is_sidechain", F.lit(False))
    keyed = rows.withColumn("_key", F.when(named, F.col("message_id")).otherwise(place)).withColumn("_request", request).repartition("_key")
    best = Window.partitionBy("_key", "_request").orderBy(total_tokens().desc(), F.col("speed").isNotNull().desc(), F.col("_old").desc(), *order)
    message = Window.partitionBy("_key")
    ranked = keyed.withColumn("_n", F.row_number().over(best)).withColumn("_chained", named & F.bool_or(side).over(message)).withColumn("read_at", F.max("read_at").over(message))
    change = F.when(~F.col("_chained"), F.when(F.col("_n") > 1, -1).when(F.col("_old"), 0).otherwise(1))
    placed = [F.when(F.col("_chained"), F.col(c)).alias(c) if c in order else F.col(c) for c in new.columns]
    ranked.where("_chained OR _n = 1 OR _old").select(*placed, "_old", "_chained", change.alias("change")).write.mode("overwrite").parquet(f"{path}/records")
    every = _written(new, path, "records").where("_chained").withColumn("_new", ~F.col("_old"))
    left = best_records(every, ("_new", *order)).withColumn("change", F.when(F.col("_old"), 0).otherwise(1))
    one = ["message_id", "_request", "_side"]
    of = lambda df: df.where("_old").withColumn("_request", request).withColumn("_side", side)
    gone = of(every).join(of(left).select(*one), one, "left_anti").withColumn("change", F.lit(-1))
    left.unionByName(gone.select(*left.columns)).drop("_new").write.mode("overwrite").parquet(f"{path}/chained")
    return folded(new, path)


def folded(new: DataFrame, path: str) -> DataFrame:
    """fold_batch()'s result read again; ``new`` gives the columns."""
    return _written(new, path, "records").where("NOT _chained").unionByName(_written(new, path, "chained")).select(*new.columns, "change")


def _written(new: DataFrame, path: str, part: str) -> DataFrame:
    """One of the two tables of fold_batch()."""
    schema = T.StructType([*new.schema.fields, T.StructField("_old", T.BooleanType()), T.StructField("_chained", T.BooleanType()), T.StructField("change", T.IntegerType())])
    return new.sparkSession.read.schema(schema).parquet(f"{path}/{part}")
