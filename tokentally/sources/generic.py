"""Agents that share one JSONL shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.dates import date_as_written, date_in_zone, parse_rfc3339, zone
from tokentally.operators.report import filter_dates
from tokentally.plans.pricing import default_prices, price_usage
from tokentally.schema import GENERIC_LINE, canonical
from tokentally.sources.base import register
from tokentally.sources.files import Options, counts_ok, expand, has_files, lines, strict_json, unique, zero
from tokentally.streaming.tail import tail


def parse_generic(raw: DataFrame, agent: str, tz: str = "UTC") -> DataFrame:
    """Canonical records from lines (value and its place): a usage that isn't all zero, and a timestamp with a zone; the session defaults to unknown.

    The zone ``log`` dates each record by its own offset.
    """
    j = strict_json(raw.where((F.octet_length("value") >= 20) & F.contains("value", F.lit('"usage"'))), "value", GENERIC_LINE)
    u = "j.message.usage"
    parts = [f"{u}.{c}" for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    ts = parse_rfc3339(F.col("j.timestamp"))
    some = zero(parts[0]) + zero(parts[1]) + zero(parts[2]) + zero(parts[3]) > 0
    own = j.where(F.col(u).isNotNull() & counts_ok(*map(F.col, parts)) & some & ts.isNotNull())
    return canonical(
        own.select(
            F.lit(agent).alias("agent"), ts.alias("ts"), (date_as_written(F.col("j.timestamp")) if tz == "log" else date_in_zone(ts, tz)).alias("date"), F.coalesce("j.sessionId", F.lit("unknown")).alias("session_id"), F.col("j.message.model").alias("model"), F.col("j.message.model").alias("price_model"),
            zero(parts[0]).alias("input_tokens"), zero(parts[1]).alias("output_tokens"), zero(parts[2]).alias("cache_creation_tokens"), zero(parts[3]).alias("cache_read_tokens"),
            F.col("j.costUSD").alias("logged_cost"), "file_path", "file_block_start", "row_id",
        )
    )


@dataclass
class GenericSource:
    name: str
    folders: tuple[str, ...]

    def paths(self) -> list[str]:
        return [str(p) for p in unique([expand(f) for f in self.folders]) if p.is_dir()]

    def available(self) -> bool:
        return has_files([expand(f) for f in self.folders], "*.jsonl")

    def read(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None) -> DataFrame:
        o = options or Options()
        found = paths if paths is not None else (self.paths() if self.available() else [])
        usage = parse_generic(lines(spark, found, since=o.since), self.name, "log" if o.timezone == "log" else zone(o.timezone))
        prices = o.prices if o.prices is not None else default_prices(spark)
        return filter_dates(price_usage(usage, prices, "logged", o.fast_multiplier_when, o.match_dated_models), o.since, o.until)

    def records(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None) -> DataFrame:
        """A stream of the records that the logs add, as they are written."""
        o = options or Options()
        usage = parse_generic(tail(spark, paths if paths is not None else self.paths()), self.name, "log" if o.timezone == "log" else zone(o.timezone))
        prices = o.prices if o.prices is not None else default_prices(spark)
        return price_usage(usage, prices, "logged", o.fast_multiplier_when, o.match_dated_models)


#: The agents and their folders.
FOLDERS = {
    "amp": ("~/.amp", "~/.config/amp"),
    "codebuff": ("~/.codebuff",),
    "copilot": ("~/.github-copilot", "~/.config/github-copilot"),
    "droid": ("~/.droid", "~/.config/droid"),
    "gemini": ("~/.gemini", "~/.config/gemini", "~/.config/google-gemini"),
    "goose": ("~/.goose", "~/.config/goose"),
    "hermes": ("~/.hermes", "~/.config/hermes"),
    "kilo": ("~/.kilo", "~/.config/kilo"),
    "kimi": ("~/.kimi", "~/.config/kimi"),
    "openclaw": ("~/.openclaw", "~/.config/openclaw"),
    "pi": ("~/.pi-agent", "~/.config/pi-agent"),
    "qwen": ("~/.qwen", "~/.config/qwen"),
}
for _name, _folders in FOLDERS.items():
    register(_name, lambda n=_name, f=_folders: GenericSource(n, f))
