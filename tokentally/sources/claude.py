"""Claude logs: projects/<project>/<session>.jsonl, with side chains and repeated lines."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.dates import date_in_zone, parse_timestamp, zone
from tokentally.functions.text import is_version, null_guard
from tokentally.operators.dedup import best_records
from tokentally.operators.report import filter_dates
from tokentally.plans.pricing import default_prices, price_usage
from tokentally.schema import CLAUDE_LINE, canonical
from tokentally.sources.base import register
from tokentally.sources.files import Options, counts_ok, env_list, expand, has_files, lines, path_parts, strict_json, unique, zero
from tokentally.streaming.tail import tail


def roots() -> list[Path]:
    """Folders of projects: from CLAUDE_CONFIG_DIR (an error if none is valid), else the two usual ones."""
    named = env_list("CLAUDE_CONFIG_DIR")
    if named:
        found = [q for p in named for q in [expand(p) / "projects" if (expand(p) / "projects").is_dir() else expand(p)] if q.name == "projects" and q.is_dir()]
        if not found:
            raise FileNotFoundError("CLAUDE_CONFIG_DIR names no folder with projects")
        return unique(found)
    xdg = os.environ.get("XDG_CONFIG_HOME") or "~/.config"
    return unique([p for p in (expand(xdg) / "claude" / "projects", expand("~/.claude/projects")) if p.is_dir()])


def project_of(path: str | Column = "file_path") -> Column:
    """The first part after ``projects``."""
    parts = path_parts(path)
    at = F.array_position(parts, "projects")
    return F.coalesce(F.when((at > 0) & (at + 1 < F.size(parts)), F.nullif(F.try_element_at(parts, (at + 1).cast("int")), F.lit(""))), F.lit("unknown"))


def session_of(path: str | Column = "file_path") -> tuple[Column, Column]:
    """(session, project path): p/s.jsonl gives (s, p), p/s/subagents/x.jsonl gives (s, p); otherwise the last folder, and what is before it."""
    parts = path_parts(path)
    at = F.array_position(parts, "projects")
    after = F.when(at > 0, F.slice(parts, (at + 1).cast("int"), F.size(parts))).otherwise(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)))
    n = F.size(after)
    name = F.regexp_replace(F.try_element_at(after, F.lit(-1)), r"\.jsonl$", "")
    sub = (n >= 4) & (F.try_element_at(after, F.lit(-2)) == "subagents")
    session = F.when(sub, F.try_element_at(after, F.lit(-3))).when(n == 2, name).otherwise(F.try_element_at(after, F.lit(-2)))
    folder = F.array_join(F.when(sub, F.slice(after, F.lit(1), n - 3)).when(n == 2, F.slice(after, F.lit(1), F.lit(1))).otherwise(F.slice(after, F.lit(1), F.greatest(n - 2, F.lit(0)))), "/")
    return F.coalesce(F.nullif(session, F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(folder, F.lit("")), F.lit("Unknown Project"))


def filled(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) != "")


def parse_claude(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """Canonical records from lines; a synthetic model isn't shown, fast mode is shown behind the name."""
    j = strict_json(raw.where(F.contains("value", F.lit('"usage":{"')) & null_guard(F.col("value"))), "value", CLAUDE_LINE)
    u = "j.message.usage"
    split = f"{u}.cache_creation"
    parts = [f"{u}.{c}" for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")] + [f"{split}.ephemeral_5m_input_tokens", f"{split}.ephemeral_1h_input_tokens"]
    ts = parse_timestamp(F.col("j.timestamp"))
    ok = F.col(u).isNotNull() & is_version(F.col("j.version")) & filled("j.sessionId") & filled("j.requestId") & filled("j.message.id") & filled("j.message.model")
    own = j.where(ok & ts.isNotNull() & counts_ok(*map(F.col, parts)))
    model = F.col("j.message.model")
    shown = F.when(model == "<synthetic>", F.lit(None)).when(F.col(f"{u}.speed") == "fast", F.concat(model, F.lit("-fast"))).otherwise(model)
    session, folder = session_of()
    created = F.when(F.col(split).isNotNull(), zero(parts[4]) + zero(parts[5])).otherwise(zero(parts[2]))
    return canonical(
        own.select(
            F.lit("claude").alias("agent"), ts.alias("ts"), date_in_zone(ts, tz).alias("date"), session.alias("session_id"), project_of().alias("project"), folder.alias("project_path"),
            F.col("j.message.id").alias("message_id"), F.col("j.requestId").alias("request_id"), F.col("j.version").alias("version"), F.coalesce("j.isSidechain", F.lit(False)).alias("is_sidechain"),
            shown.alias("model"), model.alias("price_model"), F.col(f"{u}.speed").alias("speed"), zero(parts[0]).alias("input_tokens"), zero(parts[1]).alias("output_tokens"), created.alias("cache_creation_tokens"),
            zero(parts[3]).alias("cache_read_tokens"), F.col("j.costUSD").alias("logged_cost"), "file_path", "file_block_start", "row_id",
        )
    )


class ClaudeSource:
    name = "claude"

    def paths(self, project: str | None = None) -> list[str]:
        """The roots; a project that is one path part narrows them."""
        found = roots()
        if project and "/" not in project and "\\" not in project and project not in (".", ".."):
            found = [p / project for p in found if (p / project).is_dir()]
        return [str(p) for p in found]

    def available(self) -> bool:
        try:
            return has_files(roots(), "*.jsonl")
        except FileNotFoundError:
            return False

    def read(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None) -> DataFrame:
        o = options or Options()
        found = paths if paths is not None else [p for p in self.paths(o.project) if has_files([Path(p)], "*.jsonl")]
        usage = parse_claude(lines(spark, found, since=o.since), zone(o.timezone))
        if o.project:
            usage = usage.where(F.col("project") == o.project)
        prices = o.prices if o.prices is not None else default_prices(spark)
        kept = filter_dates(best_records(usage), o.since, o.until)
        return price_usage(kept, prices, "computed", o.fast_multiplier_when, o.match_dated_models)

    def records(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None, pattern: str = "*.jsonl") -> DataFrame:
        """A stream of all records that the logs add, as they are written, repeated ones too."""
        o = options or Options()
        usage = parse_claude(tail(spark, paths if paths is not None else self.paths(o.project), pattern), zone(o.timezone))
        if o.project:
            usage = usage.where(F.col("project") == o.project)
        prices = o.prices if o.prices is not None else default_prices(spark)
        return price_usage(usage, prices, "computed", o.fast_multiplier_when, o.match_dated_models)


register("claude", ClaudeSource)
