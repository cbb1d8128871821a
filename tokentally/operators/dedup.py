"""Removal of duplicate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.schema import ORDER

def total_tokens() -> Column:
    return sum((F.col(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")), F.lit(0))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``; null keys are keys like others."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_records(usage: DataFrame, order: tuple[str, ...] = ORDER, combine: bool = False) -> DataFrame:
    """One record for each (message, request), in one scan and one shuffle by message.

    The main conversation's wins over a side chain's, then more tokens, then a known
    speed, then the earlier one.  Records without a message id all stay.  A side
    chain's record without a match of its own merges with the first side-chain
    record of its message, which depends on the order (``order`` places all records).

    That merge is: main records keep one for each request, whatever side chains do.  A message has one
    side-chain record at a time.  Those whose request has had a main record are dropped, the others compete to
    be it, and the first main record of its request puts an end to it.  Between two such first records the
    best side-chain record is all that counts, so a message comes down to one main record for each
    request and one side-chain record for each stretch between them; windows find these, and spill.  Only where a message has side
    chains is that list, of main records just (place, request), gathered and gone through, once.

    ``combine`` sums up the main records of each request before they are shuffled by message: a second shuffle, but
    worthwhile where requests repeat very often, and for a message that holds very many of all records.
    """
    none = F.col("message_id").isNull() | (F.col("message_id") == "")
    flagged = usage.select(
        F.struct(*usage.columns).alias("rec"), "message_id", F.when(none, F.monotonically_increasing_id()).alias("alone"), F.coalesce("request_id", F.lit("")).alias("rid"), F.coalesce("is_sidechain", F.lit(False)).alias("side"),
        total_tokens().alias("total"), F.col("speed").isNotNull().alias("fast"), F.struct(*order).alias("place"), F.struct(*order).alias("first"),
    )
    message = ["message_id", "alone"]
    rank = F.struct(-F.col("total"), ~F.col("fast"), F.col("place"))
    if combine:
        kept = F.struct("rec", "total", "fast", "place")
        flagged = flagged.groupBy(*message, "rid", "side", F.when(F.col("side"), F.col("place")).alias("own")).agg(F.min_by(kept, rank).alias("k"), F.min("first").alias("first")).select(*message, "rid", "side", "k.*", "first")
    placed = flagged.repartition(*message)
    so_far = Window.partitionBy(*message, "rid").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mains = F.count_if(~F.col("side")).over(so_far)
    live = placed.withColumn("opens", ~F.col("side") & (mains == 1)).withColumn("late", F.col("side") & (mains > 0)).where("NOT late")
    stretch = F.count_if("opens").over(Window.partitionBy(*message).orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chained = F.bool_or("side").over(Window.partitionBy(*message))
    at = live.withColumn("stretch", stretch).withColumn("chained", chained)
    slot = Window.partitionBy(*message, "side", F.when(F.col("side"), F.col("stretch")), F.when(~F.col("side"), F.col("rid")))
    best = at.withColumn("opened", F.min(F.when(F.col("opens"), F.col("stretch"))).over(slot)).withColumn("n", F.row_number().over(slot.orderBy(rank))).where("n = 1")
    step = F.struct(F.coalesce("opened", "stretch").alias("stretch"), "side", "rid", "total", "fast", F.when(F.col("side"), F.col("rec")).alias("rec"))
    copies = F.when(~F.col("chained"), F.array(F.lit(True))).when(F.col("side"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    dealt = best.select(*message, "rid", "rec", step.alias("step"), F.explode(copies).alias("stays"))
    dealt = dealt.groupBy(*message, "stays", F.when(F.col("stays"), F.col("rid")).alias("request")).agg(F.min_by("rec", "rid").alias("rec"), F.collect_list(F.when(~F.col("stays"), F.col("step"))).alias("steps"))
    return dealt.select(F.when(F.col("stays"), F.col("rec")).otherwise(_last_side(dealt, "steps")).alias("rec")).where("rec IS NOT NULL").select("rec.*")


def _last_side(df: DataFrame, steps: str) -> Column:
    """The side-chain record that is left of a message's steps: (stretch, side, request, ...), of which main ones open their stretch."""
    nothing = F.lit(None).cast(df.schema[steps].dataType.elementType)

    def merge(held: Column, x: Column) -> Column:
        better = held.isNull() | (x["total"] > held["total"]) | ((x["total"] == held["total"]) & x["fast"] & ~held["fast"])
        return F.when(x["side"], F.when(better, x).otherwise(held)).otherwise(F.when(held["rid"] == x["rid"], nothing).otherwise(held))

    return F.aggregate(F.array_sort(F.col(steps)), nothing, merge)["rec"]


def first_wins(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first record of each id; records with a null or empty id all stay."""
    none = F.col(key).isNull() | (F.col(key) == "")
    return first_by(df.where(~none), [key], order).unionByName(df.where(none))


def distinct_events(df: DataFrame) -> DataFrame:
    """One of each event with the same instant (in milliseconds), model and counts."""
    keys = ["model", "input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
    return df.withColumn("_ms", F.unix_millis("ts")).dropDuplicates(["_ms", *keys]).drop("_ms")


def files_first(files: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Of files with the same key the one with the smallest priority."""
    return first_by(files, key, [priority])
