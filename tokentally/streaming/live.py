"""Structured Streaming forms of the reports.

The same canonical columns come in; state stands in for re-reading all logs.
Rows behind the watermark are dropped, so choose it longer than logs lag.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokentally.schema import ORDER
from tokentally.streaming.changes import fold_batch, folded

_TOKENS = {"input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"}


def daily(stream: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Running sums; complete or update mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("records"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def blocks(stream: DataFrame, keys: tuple[str, ...] = ("agent",), gap: str = "5 hours", watermark: str = "1 day") -> DataFrame:
    """Activity blocks as session windows; a stream needs a key.  Append mode gives closed blocks."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", watermark).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("records"), F.min("ts").alias("block_start"), F.max("ts").alias("block_end"), F.sum("cost").alias("cost")).drop("w")


def deduplicated(stream: DataFrame, keys: tuple[str, ...] = ("message_id", "request_id"), watermark: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def best_records(stream: DataFrame, keys: tuple[str, ...] = ("message_id", "request_id"), watermark: str = "1 day") -> DataFrame:
    """The best record of each key so far, emitted whenever it changes; update mode.

    The main conversation's wins over a side chain's, then more tokens, then a known speed,
    then the earlier one, as in batch; the columns is_sidechain and speed may be missing.
    State is three numbers for each key, dropped once the watermark is a day past the
    key's last record.
    """
    schema = stream.schema
    columns = schema.names

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        out, last = None, 0
        for f in frames:
            f = f.sort_values("ts", kind="stable").reset_index(drop=True)
            last = max(last, int(f["ts"].max().timestamp() * 1000))
            total = sum(f[c].fillna(0) for c in columns if c in _TOKENS)
            main = ~f["is_sidechain"].fillna(False).astype(bool) if "is_sidechain" in columns else total >= 0
            fast = f["speed"].notna() if "speed" in columns else total < 0
            ranks = list(zip(main.astype(int).tolist(), total.astype(int).tolist(), fast.astype(int).tolist(), strict=True))
            top = max(ranks)
            if best is None or top > tuple(best):
                best, out = top, f.iloc[[ranks.index(top)]]
        if out is not None:
            state.update(tuple(best))
            state.setTimeoutTimestamp(max(last + 86_400_000, state.getCurrentWatermarkMs() + 1))
            yield out[columns]

    return stream.withWatermark("ts", watermark).groupBy(*keys).applyInPandasWithState(step, schema, "main int, total long, fast int", "update", GroupStateTimeout.EventTimeTimeout)


def watch(stream: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Run ``show`` on the daily sums after each interval (at least a second); micro-batches never overlap.  Stop with query.stop()."""

    def whole(sums: DataFrame, batch: int) -> None:
        sums.persist()
        sums.count()  # state is committed by reading all partitions, which ``show`` may not do
        show(sums, batch)
        sums.unpersist()

    writer = daily(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(whole)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def agents(streams: dict[str, DataFrame], watermarks: dict[str, str], default: str = "1 day", policy: str = "min") -> DataFrame:
    """The union of agents' streams of canonical records, each with a watermark of its own.

    With the policy ``min`` the slowest agent's holds, so that no row of an agent that lags is dropped,
    though state stays longer; with ``max`` the fastest one's, and what lags behind it is dropped.
    The policy belongs to the session and to the checkpoint that a query starts with.
    """
    if not streams:
        raise ValueError("no agents")
    next(iter(streams.values())).sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)
    out = None
    for name, s in streams.items():
        own = s.withColumn("agent", F.lit(name)).withWatermark("ts", watermarks.get(name, default))
        out = own if out is None else out.unionByName(own)
    return out


def closed_days(stream: DataFrame) -> DataFrame:
    """Sums by agent and day, each once, when the watermark has passed the day; append mode.  The stream has a watermark on ts."""
    w = F.window("ts", "1 day")
    sums = stream.groupBy("agent", w.alias("w")).agg(F.count("*").alias("records"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.select("agent", F.date_format("w.start", "yyyy-MM-dd").alias("date"), "records", "input_tokens", "output_tokens")


TOTALS = ("input_tokens", "output_tokens", "cost", "records")


def fold_totals(changes: DataFrame, batch: int, folder: str, keys: tuple[str, ...] = ("agent", "project", "model")) -> DataFrame:
    """Running totals by ``keys`` after this batch, written to ``folder``: those after the batch before plus the batch's changes.

    ``changes`` has ``change``, 1 or -1, beside canonical columns.  The totals are read from the last number below the batch's, so a batch that runs again gives the same.
    There is a row for each agent, project and model; no log is read again.
    """
    spark = changes.sparkSession
    signed = changes.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0)) * F.col("change")).alias(c) for c in TOTALS if c != "records"], F.sum("change").cast("bigint").alias("records"))
    known = _numbered(spark, folder)
    before = max((b for b in known if b < batch), default=None)
    if before is not None:
        signed = spark.read.schema(signed.schema).parquet(known[before]).unionByName(signed)
    signed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TOTALS]).write.mode("overwrite").parquet(f"{folder}/totals-{batch}")
    _delete(spark, [path for b, path in known.items() if before is not None and b < before])
    return spark.read.schema(signed.schema).parquet(f"{folder}/totals-{batch}")


def fold_kept(records: DataFrame, batch: int, folder: str, keep_days: float = 7.0) -> DataFrame:
    """What this batch's records add to the kept ones and take back (``change``); those kept after it are remembered in ``folder``.

    What is remembered is that of the last number below the batch's, so a batch that runs again gives the same.  A message is
    forgotten ``keep_days`` after its last record was read; what comes later is a message of its own.  Records without a message id all
    stay and aren't remembered.  A batch goes through all that is remembered.
    """
    spark = records.sparkSession
    now = datetime.datetime.now(datetime.timezone.utc)
    new = records.withColumn("read_at", F.lit(now))
    known = _numbered(spark, folder, "kept-")
    before = max((b for b in known if b < batch), default=None)
    kept = None
    if before is not None:
        kept = folded(new, known[before]).where("change >= 0 AND message_id != ''").where(F.col("read_at") > F.lit(now - datetime.timedelta(days=keep_days)))
    changes = fold_batch(new, kept, f"{folder}/kept-{batch}").where("change != 0")
    _delete(spark, [path for b, path in known.items() if before is not None and b < before])
    return changes


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for path in folders:
        p, system = _hadoop(spark, path)
        system.delete(p, True)


def _hadoop(spark: SparkSession, path: str):
    """(path, file system) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbered(spark: SparkSession, folder: str, prefix: str = "totals-") -> dict[int, str]:
    """The folders below by batch."""
    p, system = _hadoop(spark, folder)
    names = [f.getPath().getName() for f in (system.listStatus(p) if system.exists(p) else [])]
    return {int(n.removeprefix(prefix)): f"{folder}/{n}" for n in names if n.startswith(prefix)}


def totals_snapshot(totals: DataFrame) -> DataFrame:
    """report.snapshot() from running totals."""
    own = totals.where("records > 0")
    return own.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (F.sum("input_tokens") + F.sum("output_tokens")).alias("in_out_tokens"), F.sum("cost").alias("cost"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("project")).alias("projects"))


#: What the watcher needs of a record: what it is summed by, and what its rank among its message's is.
_WATCHED = ("agent", "project", "model", "message_id", "request_id", "is_sidechain", "speed", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens", "cost", *ORDER)


def watch_records(records: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "30 seconds", once: bool = False, keep_days: float = 7.0) -> StreamingQuery:
    """Run ``show`` on the running totals of the best records (operators.dedup) after each interval in which some were added.

    New lines alone are read and parsed; cycles never overlap; after a restart on the same
    checkpoint, counting goes on where it ended.  Stop with query.stop().
    """
    base = checkpoint.rstrip("/")

    def cycle(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if any(b < batch for b in _numbered(spark, f"{base}-totals")) and not any(b < batch for b in _numbered(spark, f"{base}-kept", "kept-")):
            raise ValueError(f"{checkpoint} has totals without the records they are of: it was written by an earlier version, or files are gone")
        show(fold_totals(fold_kept(df, batch, f"{base}-kept", keep_days), batch, f"{base}-totals"), batch)

    writer = records.select(*_WATCHED).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(cycle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def last_totals(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """The running totals that watch_changes() wrote last on this checkpoint; None before the first."""
    known = _numbered(spark, f"{checkpoint.rstrip('/')}-totals")
    return spark.read.parquet(known[max(known)]) if known else None


def run_to_table(df: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Process all that is available into Parquet files beside the checkpoint, and return them as a table: for bounded inputs.

    Each batch is written whole under its own number, so one that runs again replaces itself;
    in complete mode the last batch is the result, else all are.  No row comes to the driver.
    """
    spark, out, done = df.sparkSession, f"{checkpoint.rstrip('/')}-{name}", []
    schema = df.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")
        done.append(batch)

    q = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/{b}" for b in (sorted(set(done))[-1:] if mode == "complete" else sorted(set(done)))])
