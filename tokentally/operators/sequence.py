"""Running state within a log file: deltas, carried models, replays, as-of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From which day on an automatic review used which model, and the default model.
REVIEW_MODEL, DEFAULT_MODEL = "codex-auto-review", "gpt-5"
REVIEW_FALLBACKS = [("2025-08-07", "gpt-5"), ("2025-09-15", "gpt-5-codex"), ("2025-11-13", "gpt-5.1-codex"), ("2025-12-11", "gpt-5.2-codex"), ("2026-02-05", "gpt-5.3-codex"), ("2026-03-05", "gpt-5.4"), ("2026-04-23", "gpt-5.5")]


def before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def up_to_here(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_delta(df: DataFrame, column: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """Growth of a running total since the last known one, never below 0; the first counts whole."""
    last = F.last(column, ignorenulls=True).over(before(keys, order))
    return df.withColumn(out, F.greatest(F.col(column) - F.coalesce(last, F.lit(0)), F.lit(0)))


def carry_forward(df: DataFrame, column: str, out: str, keys: list[str], order: list[str], default: str | None = None) -> DataFrame:
    """The last known value so far, else the default."""
    value = F.last(column, ignorenulls=True).over(up_to_here(keys, order))
    return df.withColumn(out, F.coalesce(value, F.lit(default)) if default is not None else value)


def replay_flag(df: DataFrame, second: Column, is_usage: Column, keys: list[str], order: list[str], subagent: Column | None = None) -> DataFrame:
    """Adds ``replayed``: in a file whose first two usage events share a second, events of that second before the first event of another one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = F.when(is_usage, second)
    d = df.withColumn("_s", s).withColumn("_ord", F.row_number().over(w))
    nth = F.row_number().over(Window.partitionBy(*keys, F.col("_s").isNotNull()).orderBy(*order))
    d = d.withColumn("_nth", F.when(F.col("_s").isNotNull(), nth))
    one, two = (F.max(F.when(F.col("_nth") == k, F.col("_s"))).over(whole) for k in (1, 2))
    d = d.withColumn("_replay", F.when((one == two) & (subagent if subagent is not None else F.lit(True)), one))
    end = F.min(F.when(is_usage & (F.coalesce(second, F.lit("")) != F.col("_replay")), F.col("_ord"))).over(whole)
    return d.withColumn("_end", end).withColumn("replayed", F.coalesce(is_usage & (F.col("_s") == F.col("_replay")) & (F.col("_end").isNull() | (F.col("_ord") < F.col("_end"))), F.lit(False))).drop("_s", "_ord", "_nth", "_replay", "_end")


def as_of(df: DataFrame, key: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The value of the table's last row whose key isn't after ``key``; the table is a short list of constants, so this is one expression."""
    out = F.lit(default)
    for start, value in sorted(table):
        out = F.when(key >= start, value).otherwise(out)
    return out


def review_model(model: Column, ts_text: Column) -> Column:
    """The model that stood behind an automatic review at that time."""
    day = F.when(F.length(ts_text) >= 10, F.substring(ts_text, 1, 10)).otherwise("")
    return F.when(model == REVIEW_MODEL, as_of(None, day, REVIEW_FALLBACKS, DEFAULT_MODEL)).otherwise(model)


def position(df: DataFrame, out: str = "row_id") -> DataFrame:
    """A row's place, taken right after the scan: rising within each file split."""
    return df.withColumn(out, F.monotonically_increasing_id())
