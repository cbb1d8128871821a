"""Reports: sums by period, session, project and model; totals, breakdowns and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.functions import dates
from tokentally.schema import COUNTS


def measures() -> list[Column]:
    """Sums; credits and message counts stay null where no record has any."""
    return [*[F.sum(c).alias(c) for c in COUNTS], F.sum("cost").alias("cost"), F.sum("credits").alias("credits"), F.sum("message_count").alias("message_count"), F.count("*").alias("records")]


def entry_total() -> Column:
    """Tokens without reasoning: of entries, blocks and report totals."""
    return sum((F.col(c) for c in COUNTS if c != "reasoning_tokens"), F.lit(0))


def row_total() -> Column:
    """Tokens with reasoning: of report rows."""
    return entry_total() + F.col("reasoning_tokens")


def summarize(usage: DataFrame, keys: list[str], breakdown: bool = True, extra: dict[str, tuple[Column, Callable[[str], Column]]] | None = None) -> DataFrame:
    """One row for each key: measures, total_tokens, models_used and, if asked for, model_breakdowns (by cost, dearest first).

    Records are summed by (key, model) first, so what is gathered by key has a row
    for each model.  A null model counts in the sums and in no breakdown.  ``extra``
    holds further columns: an aggregate over the records, and how the models' ones are put together.
    """
    extra = extra or {}
    by_model = usage.groupBy(*keys, "model").agg(*measures(), F.bool_or(F.col("missing_pricing_model").isNotNull()).alias("missing"), *[first.alias(name) for name, (first, _) in extra.items()])
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "cost", "credits", "message_count", "records")]
    detail = F.struct((-F.col("cost")).alias("rank"), F.col("model"), *COUNTS, "cost", "missing")
    lists = [F.sort_array(F.collect_set("model")).alias("models_used")]
    if breakdown:
        lists.append(F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), detail))).alias("model_breakdowns"))
    out = by_model.groupBy(*keys).agg(*sums, *lists, *[again(name).alias(name) for name, (_, again) in extra.items()]).withColumn("total_tokens", row_total())
    if breakdown:
        out = out.withColumn("model_breakdowns", F.transform("model_breakdowns", lambda m: m.dropFields("rank")))
    return out


def period_report(usage: DataFrame, kind: str = "daily", start_of_week: str = "monday", by: tuple[str, ...] = (), breakdown: bool = True) -> DataFrame:
    """Daily, weekly or monthly rows (column ``date``), straight from the records; those without a date are left out."""
    own = usage.where("date IS NOT NULL AND date != ''").withColumn("date", dates.bucket(F.col("date"), kind, start_of_week))
    return summarize(own, ["date", *by], breakdown)


def session_report(usage: DataFrame, breakdown: bool = True) -> DataFrame:
    """Rows by session: also first and last activity, the project path at the last one, and versions."""
    extra = {
        "first_activity": (F.min("ts"), F.min),
        "last_activity": (F.max("ts"), F.max),
        "project_path": (F.max(F.struct("ts", "file_path", "file_block_start", "row_id", "project_path")), F.max),
        "versions": (F.collect_set("version"), lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))),
    }
    out = summarize(usage, ["session_id"], breakdown, extra)
    return out.withColumn("project_path", F.col("project_path.project_path"))


def all_agents(sources: list[DataFrame], kind: str = "daily", breakdown: bool = True) -> DataFrame:
    """Rows by date and agent over the union of all sources."""
    return period_report(union_all(sources), kind, by=("agent",), breakdown=breakdown)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def grand_totals(rows: DataFrame) -> DataFrame:
    """One row over a report's rows; total_tokens without reasoning; credits only where above 0."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "cost", "records")], F.sum("credits").alias("credits"), F.sum("message_count").alias("message_count"))
    return sums.withColumn("credits", F.when(F.col("credits") > 0, F.col("credits"))).withColumn("total_tokens", entry_total())


def rollup(usage: DataFrame, keys: tuple[str, ...] = ("date", "model")) -> DataFrame:
    """Rows, sub-totals and the grand total in one pass; ``level`` tells them apart (0 is a row)."""
    return usage.rollup(*keys).agg(*measures(), F.grouping_id().alias("level"))


def filter_dates(usage: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records between two dates, both inclusive."""
    return usage.where(dates.in_range(F.col("date"), since, until))


def filter_models(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows any of whose models contains the pattern, whatever the case; the row's sums stay whole."""
    return rows.where(F.exists("models_used", lambda m: F.contains(F.lower(m), F.lit(pattern.lower()))))


def sort_report(rows: DataFrame, order: str = "asc", key: str = "date") -> DataFrame:
    ties = [c for c in ("agent", "session_id", "project") if c in rows.columns and c != key]
    return rows.orderBy(F.col(key).desc() if order == "desc" else F.col(key).asc(), *ties)


def missing_models(rows: DataFrame) -> DataFrame:
    """Distinct models without a price, from the breakdowns."""
    return rows.select(F.explode("model_breakdowns").alias("m")).where("m.missing").select("m.model").distinct()


def by_project(rows: DataFrame) -> DataFrame:
    """Report rows as one list for each project."""
    rest = [c for c in rows.columns if c != "project"]
    return rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))


def without_costs(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "cost" in c.lower()])


def snapshot(usage: DataFrame) -> DataFrame:
    """What the watcher shows: input, output, their sum, cost, records, and how many models and projects; both are small sets."""
    return usage.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (F.sum("input_tokens") + F.sum("output_tokens")).alias("in_out_tokens"), F.sum("cost").alias("cost"), F.count("*").alias("records"), F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("project")).alias("projects"))
