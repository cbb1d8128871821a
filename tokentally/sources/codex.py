"""Codex logs: session events with running totals, and headless results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.functions.dates import bucket, date_in_zone, flexible_timestamp, in_range, millis_text, parse_timestamp, zone
from tokentally.functions.text import first_filled
from tokentally.operators.dedup import files_first
from tokentally.operators.report import filter_dates
from tokentally.operators.sequence import DEFAULT_MODEL, REVIEW_MODEL, before, carry_forward, replay_flag, review_model, up_to_here
from tokentally.plans.pricing import cached_cost, default_prices, with_prices
from tokentally.schema import CODEX_LINE, CODEX_PAYLOAD, CODEX_RESULT, canonical
from tokentally.sources.base import register
from tokentally.sources.files import Options, env_list, expand, file_names, has_files, lines, strict_json, unique, zero
from tokentally.sources.heads import file_heads

#: From this size on of some file, files are worked on by stretches of SEGMENT_ROWS lines instead of one by one.
BIG_FILE, SEGMENT_ROWS = 256 << 20, 1 << 16
_KEYS, _ORDER = ["file_path"], ["file_block_start", "row_id"]
_USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def source_folders() -> list[tuple[str, str, int]]:
    """(folder, scope, priority): a home's sessions before its archived ones, else the home itself; earlier homes first."""
    out = []
    for home in unique([expand(p) for p in env_list("CODEX_HOME") or ["~/.codex"]]):
        own = [home / n for n in ("sessions", "archived_sessions") if (home / n).is_dir()] or ([home] if home.is_dir() else [])
        out += [(str(p), str(home), len(out) + k) for k, p in enumerate(own)]
    return out


def kind(value: Column) -> Column:
    """session, headless or null, by what stands in the line."""
    has = lambda s: F.contains(value, F.lit(s))
    event, typed = has('"type":"event_msg"'), has('"type"')
    session = has('"type":"turn_context"') | (event & has('"type":"token_count"')) | (~event & typed & (F.octet_length(value) < 65_536) & has('"token_count"')) | ((event | ~typed) & (has('"turn_context"') | (has('"event_msg"') & has('"token_count"'))))
    headless = has('"usage"') | has('"input_tokens"') | has('"prompt_tokens"')
    return F.when(session, "session").when(headless, "headless")


def _model(prefix: str) -> Column:
    """model, model_name or the metadata's model."""
    return first_filled(F.col(f"{prefix}model"), F.col(f"{prefix}model_name"), F.get_json_object(F.col(f"{prefix}metadata"), "$.model"))


def _normal(u: str) -> dict[str, Column]:
    """The five counts of a headless usage, from whichever names it has; other names count where the first is 0."""
    c = lambda n: F.col(f"{u}.{n}")
    alias = lambda first, *more: F.coalesce(F.nullif(c(first), F.lit(0)), *[c(m) for m in more], F.lit(0)).cast("bigint")
    out = {"input_tokens": alias("input_tokens", "prompt_tokens", "input"), "cached_input_tokens": alias("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"), "output_tokens": alias("output_tokens", "completion_tokens", "output"), "reasoning_output_tokens": alias("reasoning_output_tokens", "reasoning_tokens")}
    out["total_tokens"] = F.coalesce(F.nullif(c("total_tokens"), F.lit(0)), out["input_tokens"] + out["output_tokens"] + out["reasoning_output_tokens"])
    return out


def parse_codex(raw: DataFrame, session_id: Column | None = None, heads: DataFrame | None = None, segment_rows: int | None = None) -> DataFrame:
    """Events from lines: session_id, ts_text, model, the five counts, is_fallback, and their place.

    Running totals become growth, a model holds until the next one, and events
    that a sub-agent's file replays from its parent are left out, though their totals count.
    All state is within a file.  ``heads`` (file_path, head) holds the beginning of each file, in which a sub-agent's
    one says so; without it any line may.

    A file is one task's, unless ``segment_rows`` is given: then each stretch of so many rows is reduced to its last totals,
    its last model and its first usage events, these are scanned for each file, and the stretches go on
    from what comes in, each in a task of its own.
    """
    typed = raw.withColumn("kind", kind(F.col("value"))).withColumn("spawned", F.contains("value", F.lit("thread_spawn")) if heads is None else F.lit(False))
    j = strict_json(typed.where("kind IS NOT NULL OR spawned"), "value", CODEX_LINE, keep=F.col("spawned"))
    j = j.withColumn("kind", F.when(F.col("j").isNotNull() & F.col("j._corrupt_record").isNull(), F.col("kind")))
    if heads is not None:
        j = j.drop("spawned").join(heads.select("file_path", F.contains("head", F.lit("thread_spawn")).alias("spawned")), "file_path", "left").withColumn("spawned", F.coalesce("spawned", F.lit(False)))
    j = j.withColumn("p", F.from_json("j.payload", CODEX_PAYLOAD)).withColumn("line_ts", flexible_timestamp(F.col("j.timestamp")))
    for part in ("data", "result", "response"):
        j = j.withColumn(part, F.from_json(f"j.{part}", CODEX_RESULT))
    session = F.col("kind") == "session"
    info = F.col("p.info")
    event = F.coalesce(session & (F.col("j.type") == "event_msg"), F.lit(False))
    counted = event & ((F.col("p.info.last_token_usage").isNotNull()) | F.col("p.info.total_token_usage").isNotNull())
    second = F.when(F.length("line_ts") >= 19, F.substring("line_ts", 1, 19))
    told_time = event & info.isNotNull() & F.col("line_ts").isNotNull()
    totals = F.when(told_time & F.col("p.info.total_token_usage").isNotNull(), F.struct(*[zero(f"p.info.total_token_usage.{c}").alias(c) for c in _USAGE]))
    j = j.withColumns({"event": event, "counted": counted, "usage_second": F.when(counted & (F.col("p.type") == "token_count"), second), "totals": totals, "told_time": told_time, "place": F.struct(*_ORDER)})
    state = _Segments(j, segment_rows) if segment_rows else _Files(j)
    j = state.with_totals()
    live = F.col("told_time") & ~F.col("replayed")
    grown = {c: F.greatest(F.col(f"totals.{c}") - F.coalesce(F.col(f"before.{c}"), F.lit(0)), F.lit(0)) for c in _USAGE}
    ours = {c: F.when(F.col("p.info.last_token_usage").isNotNull(), zero(f"p.info.last_token_usage.{c}")).otherwise(zero(grown[c])) for c in _USAGE}
    head = F.coalesce(*[F.when(F.col(f"{s}.usage").isNotNull(), F.struct(*[v.alias(k) for k, v in _normal(f"{s}.usage").items()])) for s in ("j", "data", "result", "response")])
    headless = F.col("kind") == "headless"
    j = j.withColumn("u", F.when(session, F.when(live & F.col("counted"), F.struct(*[ours[c].alias(c) for c in _USAGE]))).when(headless, head))
    some = F.greatest(*[F.col(f"u.{c}") for c in _USAGE]) > 0
    context = F.when(session & (F.col("j.type") == "turn_context"), F.coalesce(_model("p."), _model("p.info.")))
    told = F.when(session & some, F.coalesce(_model("p."), _model("p.info.")))
    headless_told = F.when(headless & some, F.coalesce(_model("j."), *[_model(f"{s}.") for s in ("data", "result", "response")]))
    j = state.with_models(j.withColumn("told", F.coalesce(context, told, headless_told)).withColumn("is_event", F.coalesce(some, F.lit(False))))
    stamps = [flexible_timestamp(F.col(f"{s}.{c}")) for s in ("j", "data", "result", "response") for c in ("timestamp", "created_at", "createdAt")]
    stamp = F.when(session, F.col("line_ts")).otherwise(F.coalesce(*stamps, millis_text(F.col("file_time"))))
    j = j.withColumn("ts_text", stamp).withColumn("named", F.coalesce("carried", F.lit(DEFAULT_MODEL)))
    own_id = session_id if session_id is not None else F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.jsonl$", "")
    return j.where("is_event AND ts_text IS NOT NULL").select(
        own_id.alias("session_id"), "ts_text", review_model(F.col("named"), F.col("ts_text")).alias("model"), F.col("u.input_tokens").alias("input_tokens"), F.least("u.cached_input_tokens", "u.input_tokens").alias("cached_tokens"),
        F.col("u.output_tokens").alias("output_tokens"), F.col("u.reasoning_output_tokens").alias("reasoning_tokens"), F.col("u.total_tokens").alias("total_tokens"),
        (F.col("first_unknown") | (F.col("named") == REVIEW_MODEL)).alias("is_fallback"), "file_path", "file_block_start", "row_id",
    )


class _Files:
    """State by windows over whole files, after one shuffle by file."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.withColumn("subagent", F.bool_or("spawned").over(Window.partitionBy(*_KEYS)))

    def with_totals(self) -> DataFrame:
        """``before``: the last totals before the row; ``replayed``."""
        j = replay_flag(self.rows, F.col("usage_second"), F.col("usage_second").isNotNull(), _KEYS, _ORDER, F.col("subagent"))
        return j.withColumn("before", F.last("totals", ignorenulls=True).over(before(_KEYS, _ORDER)))

    def with_models(self, j: DataFrame) -> DataFrame:
        """``carried``: the last model up to the row; ``first_unknown``: the file's first event, if it has none."""
        j = carry_forward(j, "told", "carried", _KEYS, _ORDER)
        nth = F.count_if("is_event").over(up_to_here(_KEYS, _ORDER))
        return j.withColumn("first_unknown", F.col("is_event") & F.col("carried").isNull() & (nth == 1))


class _Segments:
    """The same by stretches of rows.  What a stretch comes down to is one row of bounded size; a file has as many as it has stretches."""

    def __init__(self, rows: DataFrame, size: int):
        self.keys = [*_KEYS, "segment"]
        self.rows = rows.withColumn("segment", F.struct("file_block_start", F.floor(F.col("row_id") / size).alias("n"))).repartition(*self.keys)
        self.earlier = Window.partitionBy(*_KEYS).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        self.file = Window.partitionBy(*_KEYS)

    def with_totals(self) -> DataFrame:
        used = F.col("usage_second").isNotNull()
        events = F.array_sort(F.collect_list(F.when(used, F.struct("place", F.col("usage_second").alias("s")))))
        one = self.rows.groupBy(*self.keys).agg(F.max_by("totals", F.when(F.col("totals").isNotNull(), F.col("place"))).alias("last"), F.bool_or("spawned").alias("spawned"), events.alias("e"))
        another = F.try_element_at(F.filter("e", lambda x: x["s"] != F.col("e")[0]["s"]), F.lit(1))
        one = one.select(*self.keys, "last", "spawned", F.slice("e", 1, 2).alias("two"), another.alias("another"))
        # A file's first two usage events are among the first two of its first stretches that have any.
        first = F.min_by("two", F.when(F.size("two") > 0, F.col("segment")))
        then = one.select("file_path", "segment", "two", "spawned", F.min(F.when(F.size("two") > 0, F.col("segment"))).over(self.file).alias("from"))
        files = then.groupBy("file_path").agg(first.alias("two"), F.min_by("two", F.when((F.size("two") > 0) & (F.col("segment") != F.col("from")), F.col("segment"))).alias("more"), F.bool_or("spawned").alias("subagent"))
        both = F.concat("two", F.coalesce("more", F.array().cast(files.schema["two"].dataType)))
        replay = F.when(F.col("subagent") & (F.try_element_at(both, F.lit(1))["s"] == F.try_element_at(both, F.lit(2))["s"]), F.try_element_at(both, F.lit(1))["s"])
        one = one.join(files.select("file_path", replay.alias("replay")), "file_path", "left")
        stop = F.when(F.try_element_at("two", F.lit(1))["s"] != F.col("replay"), F.try_element_at("two", F.lit(1))["place"]).otherwise(F.col("another.place"))
        one = one.select(*self.keys, "replay", F.min(stop).over(self.file).alias("stop"), F.last("last", ignorenulls=True).over(self.earlier).alias("comes"))
        j = self.rows.join(one, self.keys, "left")
        within = F.last("totals", ignorenulls=True).over(before(self.keys, _ORDER))
        replayed = F.coalesce((F.col("usage_second") == F.col("replay")) & (F.col("stop").isNull() | (F.col("place") < F.col("stop"))), F.lit(False))
        return j.withColumn("before", F.coalesce(within, F.col("comes"))).withColumn("replayed", replayed)

    def with_models(self, j: DataFrame) -> DataFrame:
        one = j.groupBy(*self.keys).agg(F.max_by("told", F.when(F.col("told").isNotNull(), F.col("place"))).alias("last"), F.min(F.when(F.col("is_event"), F.col("place"))).alias("event"))
        one = one.select(*self.keys, F.last("last", ignorenulls=True).over(self.earlier).alias("model_comes"), F.min("event").over(self.file).alias("first_event"))
        j = j.join(one, self.keys, "left")
        carried = F.coalesce(F.last("told", ignorenulls=True).over(up_to_here(self.keys, _ORDER)), F.col("model_comes"))
        return j.withColumn("carried", carried).withColumn("first_unknown", F.col("is_event") & F.col("carried").isNull() & (F.col("place") == F.col("first_event")))


def group_events(events: DataFrame, kind: str = "daily", tz: str = "UTC", start_of_week: str = "monday", since: str | None = None, until: str | None = None) -> DataFrame:
    """Sums by (period, model); the period is the day, week or month in the zone, or the session."""
    ts = parse_timestamp(F.col("ts_text"))
    own = events.where((F.col("model") != "") & ts.isNotNull() & in_range(date_in_zone(ts, tz), since, until)).withColumn("period", F.col("session_id") if kind == "session" else bucket(date_in_zone(ts, tz), kind, start_of_week))
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens")]
    return own.groupBy("period", "model").agg(*sums, F.max("ts_text").alias("last_activity"), F.bool_or("is_fallback").alias("is_fallback"))


def codex_report(events: DataFrame, prices: DataFrame, kind: str = "daily", tz: str = "UTC", fast: bool = False, start_of_week: str = "monday", since: str | None = None, until: str | None = None) -> DataFrame:
    """One row for each period: sums, cost and a map of the models' usage."""
    groups = with_prices(group_events(events, kind, tz, start_of_week, since, until), prices, "model").withColumn("cost", cached_cost("price_", fast))
    detail = F.struct("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "cost", "is_fallback")
    return groups.groupBy("period").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("cost"), F.max("last_activity").alias("last_activity"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", detail.alias("usage"))))).alias("models"))


def to_usage(events: DataFrame, prices: DataFrame, tz: str = "UTC", fast: bool = False) -> DataFrame:
    """Canonical records, one for each event: input without its cached part, which is read from the cache."""
    ts = parse_timestamp(F.col("ts_text"))
    priced = with_prices(events.where((F.col("model") != "") & ts.isNotNull()), prices, "model").withColumn("cost", cached_cost("price_", fast))
    return canonical(
        priced.select(
            F.lit("codex").alias("agent"), ts.alias("ts"), date_in_zone(ts, tz).alias("date"), "session_id", F.lit("codex").alias("project"), F.lit("Codex").alias("project_path"), "model", F.col("model").alias("price_model"),
            F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0)).alias("input_tokens"), "output_tokens", F.col("cached_tokens").alias("cache_read_tokens"), "reasoning_tokens", "cost",
            F.when(F.col("price_known").isNull(), F.col("model")).alias("missing_pricing_model"), "file_path", "file_block_start", "row_id",
        )
    )


class CodexSource:
    name = "codex"

    def paths(self) -> list[str]:
        return [p for p, _, _ in source_folders()]

    def available(self) -> bool:
        return has_files([Path(p) for p in self.paths()], "*.jsonl")

    def fast(self) -> bool:
        """Whether a config asks for the fast tier."""
        import re

        configs = [Path(scope) / "config.toml" for _, scope, _ in source_folders()]
        return any(re.search(r'(?m)^\s*service_tier\s*=\s*"?(fast|priority)"?\s*$', c.read_text(errors="replace")) for c in configs if c.is_file())

    def events(self, spark: SparkSession, folders: list[tuple[str, str, int]] | None = None) -> DataFrame:
        """Events of all folders; a file that two folders of one scope hold is taken from the first."""
        told = folders if folders is not None else [f for f in source_folders() if has_files([Path(f[0])], "*.jsonl")]
        raw = lines(spark, [f[0] for f in told])
        if not told:
            return parse_codex(raw)
        # The folders are few; each file's is the one that its path begins with.
        at = F.lit(None).cast("struct<root: string, scope: string, priority: int>")
        for root, scope, priority in sorted(told, key=lambda f: len(f[0])):
            at = F.when(F.regexp_replace("file_path", "^file:/*", "/").startswith(root.rstrip("/").removeprefix("file://") + "/"), F.struct(F.lit(root).alias("root"), F.lit(scope).alias("scope"), F.lit(priority).alias("priority"))).otherwise(at)
        rel = F.element_at(F.split(F.regexp_replace("file_path", "^file:/*", "/"), F.concat(F.lit(r"^\Q"), F.regexp_replace("at.root", "/$", ""), F.lit(r"/\E"))), -1)
        placed = lambda df: df.withColumn("at", at).withColumn("rel", rel)
        if len(told) > 1:  # the files' names alone are listed, no line is read for it
            files = placed(file_names(spark, [f[0] for f in told])).select("file_path", "at.scope", "rel", "at.priority")
            raw = raw.join(files_first(files, ["scope", "rel"], "priority").select("file_path"), "file_path", "left_semi")
        heads = file_heads(spark, [f[0] for f in told])
        largest = heads.agg(F.max("bytes")).first()[0] or 0  # names and sizes; no file is read for it but its beginning
        return parse_codex(placed(raw).drop("at"), F.regexp_replace("rel", r"\.jsonl$", ""), heads, SEGMENT_ROWS if largest > BIG_FILE else None)

    def read(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None) -> DataFrame:
        o = options or Options()
        folders = [(p, p, k) for k, p in enumerate(paths)] if paths is not None else None
        prices = o.prices if o.prices is not None else default_prices(spark)
        return filter_dates(to_usage(self.events(spark, folders), prices, zone(o.timezone), paths is None and self.fast()), o.since, o.until)


register("codex", CodexSource)
