"""Activity blocks: runs of records without a gap longer than a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activity_blocks(usage: DataFrame, keys: list[str] | None = None, session_seconds: int = 18_000, total: Column | None = None) -> DataFrame:
    """One row for each block of each key: block_start, block_end, records, tokens, cost, models, is_active, actual_end.

    Records are first summed up in time slots as wide as the longest gap a block
    bears: two neighbours in one slot can't be a block apart, so only slots need
    an order.  However many records there are, a key has at most one row for each such
    span of time.  A gap of exactly that length stays in the block.  The
    last block of a key is active and has no actual end.  Null timestamps take no
    part.
    """
    keys = keys or []
    micros, width = F.unix_micros("ts"), session_seconds * 1_000_000
    tokens = total if total is not None else sum((F.col(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")), F.lit(0))
    slots = (
        usage.where("ts IS NOT NULL").groupBy(*keys, F.floor(micros / width).alias("slot"))
        .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"), F.sum(tokens).alias("t"), F.sum("cost").alias("c"), F.collect_set("model").alias("m"))
    )
    order = Window.partitionBy(*keys).orderBy("slot")
    new = F.coalesce(F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(order)) > width, F.lit(True))
    numbered = slots.withColumn("new", new).withColumn("block", F.sum(F.col("new").cast("int")).over(order))
    models = F.array_sort(F.array_distinct(F.flatten(F.collect_list("m"))))
    blocks = numbered.groupBy(*keys, "block").agg(F.min("lo").alias("block_start"), F.max("hi").alias("block_end"), F.sum("n").alias("records"), F.sum("t").alias("tokens"), F.sum("c").alias("cost"), models.alias("models"))
    last = F.max("block").over(Window.partitionBy(*keys))
    return blocks.withColumn("is_active", F.col("block") == last).withColumn("actual_end", F.when(F.col("block") != last, F.col("block_end")))


def gap_rows(blocks: DataFrame, keys: list[str] | None = None, session_seconds: int = 18_000) -> DataFrame:
    """A row between blocks more than two sessions apart: gap_start, gap_end, gap_id."""
    keys = keys or []
    after = F.lead("block_start").over(Window.partitionBy(*keys).orderBy("block"))
    gaps = blocks.withColumn("gap_end", after).where(F.unix_micros("gap_end") - F.unix_micros("block_end") > 2_000_000 * session_seconds)
    return gaps.select(*keys, F.col("block_end").alias("gap_start"), "gap_end", F.concat(F.lit("gap-"), F.date_format("block_end", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("gap_id"))


def block_minutes() -> Column:
    return F.greatest((F.unix_micros("block_end") - F.unix_micros("block_start")) / 60_000_000, F.lit(0.1))


def burn_rate(blocks: DataFrame) -> DataFrame:
    """tokens_per_minute and cost_per_hour; a block lasts a tenth of a minute at least."""
    return blocks.withColumn("tokens_per_minute", F.col("tokens") / block_minutes()).withColumn("cost_per_hour", F.col("cost") / block_minutes() * 60)


def projection(blocks: DataFrame, limit: int = 500_000) -> DataFrame:
    """remaining_minutes until the limit at the block's rate; 0 without a rate or beyond the limit."""
    rate = F.col("tokens") / block_minutes()
    left = F.when((rate <= 0) | (F.col("tokens") >= limit), F.lit(0).cast("bigint")).otherwise(F.floor((limit - F.col("tokens")) / rate).cast("bigint"))
    return blocks.withColumn("remaining_minutes", left)
