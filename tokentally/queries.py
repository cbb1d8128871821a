"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions import dates, text
from tokentally.operators import blocks, dedup, report, sequence
from tokentally.plans import pricing
from tokentally.schema import _CODEX_USAGE
from tokentally.session import configure, scratch
from tokentally.sources import codex
from tokentally.sources.tables import events_usage, lineitem_usage, orders_usage, table
from tokentally.streaming import live

#: Prices of the five event types, dollars for a million tokens: input, output, cache creation, cache reads, input above, output above, multiplier.
EVENT_PRICES = [("click", 2.0, 10.0, 3.0, 0.5, None, None, 1.0), ("view", 1.0, 4.0, 1.25, 0.1, 1.5, 8.0, 1.0), ("purchase", 5.0, 25.0, 6.25, 0.5, None, None, 2.0), ("signup", 3.0, 15.0, 3.75, 0.3, None, None, 1.0)]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if sql:
            _SQL[name] = f"WITH {_COMMON.rstrip()}{sql}" if sql.startswith(",") else f"WITH {_COMMON}\n{sql}"
        return f

    return add


def prices(spark: SparkSession) -> DataFrame:
    rows = [(m, *[x / 1e6 if x is not None else None for x in v[:6]], v[6]) for m, *v in EVENT_PRICES]
    return pricing.price_table(spark.createDataFrame(rows, "model string, input double, output double, cache_create double, cache_read double, input_above double, output_above double, multiplier double"))


def events(spark: SparkSession, sf_dir: str, tz: str = "UTC") -> DataFrame:
    return pricing.price_usage(events_usage(spark, sf_dir, tz), prices(spark))


def money(c: str | Column, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


_PRICES_SQL = ", ".join(f"('{m}', {i}/1e6, {o}/1e6, {'NULL' if ia is None else f'{ia}/1e6'}, {'NULL' if oa is None else f'{oa}/1e6'}, {x})" for m, i, o, _, _, ia, oa, x in EVENT_PRICES)
_COMMON = f"""
e0 AS (SELECT event_id, ts, user_id, event_type AS model, coalesce(value, 0) AS value, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS input_tokens, CAST(floor(coalesce(value, 0)) AS BIGINT) AS output_tokens, strftime(ts, '%Y-%m-%d') AS date FROM events),
prices(model, i, o, ia, oa, m) AS (VALUES {_PRICES_SQL}),
e AS (SELECT e0.*, 'p' || (user_id % 7) AS project, prices.model IS NULL AS missing,
  coalesce(CASE WHEN m = 1 THEN c ELSE round(c * m * 1e8) / 1e8 END, 0) AS cost
  FROM (SELECT e0.*, CASE WHEN e0.input_tokens <= 200000 OR p.ia IS NULL THEN e0.input_tokens * p.i ELSE 200000 * p.i + (e0.input_tokens - 200000) * p.ia END + CASE WHEN e0.output_tokens <= 200000 OR p.oa IS NULL THEN e0.output_tokens * p.o ELSE 200000 * p.o + (e0.output_tokens - 200000) * p.oa END AS c FROM e0 LEFT JOIN prices p ON p.model = e0.model) e0 LEFT JOIN prices ON prices.model = e0.model)
"""
_SUMS = "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 4) AS cost, count(*) AS records"


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "input_tokens", "output_tokens", money("cost").alias("cost"), "records")


# Scans, grouping, totals.


@query(f"SELECT date, {_SUMS}, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM e GROUP BY date ORDER BY date")
def daily_usage(spark, d):
    r = report.sort_report(report.period_report(events(spark, d)))
    return r.select("date", "input_tokens", "output_tokens", money("cost").alias("cost"), "records", F.array_join("models_used", ",").alias("models"))


@query(f"SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS date, {_SUMS} FROM e GROUP BY 1")
def weekly_usage_mon(spark, d):
    return sums(report.period_report(events(spark, d), "weekly", breakdown=False), "date")


@query(f"SELECT strftime(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER), '%Y-%m-%d') AS date, {_SUMS} FROM e GROUP BY 1")
def weekly_usage_sun(spark, d):
    return sums(report.period_report(events(spark, d), "weekly", "sunday", breakdown=False), "date")


@query(f"SELECT date[1:7] AS date, {_SUMS} FROM e GROUP BY 1")
def monthly_usage(spark, d):
    return sums(report.period_report(events(spark, d), "monthly", breakdown=False), "date")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS date, count(*) AS records, CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS output_tokens, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1")
def monthly_orders(spark, d):
    r = report.period_report(orders_usage(spark, d), "monthly", breakdown=False)
    return r.select("date", "records", "output_tokens", money("cost", 2).alias("cost"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS session_id, {_SUMS}, min(ts) AS first_activity, max(ts) AS last_activity, '/work/p' || any_value(user_id % 7) AS project_path, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM e GROUP BY user_id")
def session_usage(spark, d):
    r = report.session_report(events(spark, d), breakdown=False)
    return r.select("session_id", "input_tokens", "output_tokens", money("cost").alias("cost"), "records", F.col("first_activity").cast("timestamp_ntz").alias("first_activity"), F.col("last_activity").cast("timestamp_ntz").alias("last_activity"), "project_path", F.array_join("models_used", ",").alias("models"))


@query(f"SELECT date, model, {_SUMS.replace(', count(*) AS records', '')}, bool_or(missing) AS missing FROM e WHERE model IS NOT NULL GROUP BY date, model")
def model_breakdown(spark, d):
    m = report.period_report(events(spark, d)).select("date", F.explode("model_breakdowns").alias("m"))
    return m.select("date", "m.model", "m.input_tokens", "m.output_tokens", money("m.cost").alias("cost"), "m.missing")


@query("SELECT date, string_agg(model, '>' ORDER BY c DESC, model) AS ranked FROM (SELECT date, model, sum(cost) AS c FROM e WHERE model IS NOT NULL GROUP BY 1, 2) GROUP BY date")
def breakdown_ranked(spark, d):
    return report.period_report(events(spark, d)).select("date", F.array_join(F.transform("model_breakdowns", lambda m: m["model"]), ">").alias("ranked"))


@query(f"SELECT date, project, {_SUMS} FROM e GROUP BY date, project")
def daily_by_project(spark, d):
    return sums(report.period_report(events(spark, d), by=("project",), breakdown=False), "date", "project")


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, 's' || (l_suppkey % 5) AS project, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(l_quantity * 2 AS BIGINT)) AS BIGINT) AS output_tokens, round(sum(l_extendedprice), 2) AS cost, count(*) AS records FROM lineitem GROUP BY 1, 2")
def daily_lineitem(spark, d):
    r = report.period_report(lineitem_usage(spark, d), by=("project",), breakdown=False)
    return r.select("date", "project", "input_tokens", "output_tokens", money("cost", 2).alias("cost"), "records")


@query("SELECT project, count(*) AS days, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT project, date, sum(input_tokens + output_tokens) AS t FROM e GROUP BY 1, 2) GROUP BY project")
def rows_by_project(spark, d):
    r = report.by_project(report.period_report(events(spark, d), by=("project",), breakdown=False))
    return r.select("project", F.size("rows").cast("bigint").alias("days"), F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, x: a + x["total_tokens"]).alias("total_tokens"))


@query("SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, round(sum(cost), 4) AS cost, count(*) AS records, round(sum(CASE WHEN model = 'purchase' THEN round(value / 100, 6) END), 4) AS credits FROM e")
def usage_totals(spark, d):
    t = report.grand_totals(report.period_report(events(spark, d), breakdown=False))
    return t.select("input_tokens", "output_tokens", "total_tokens", money("cost").alias("cost"), "records", money("credits").alias("credits"))


@query(f"SELECT date, model, CAST(grouping(date) * 2 + grouping(model) AS BIGINT) AS level, {_SUMS} FROM e GROUP BY ROLLUP (date, model)")
def usage_rollup(spark, d):
    return sums(report.rollup(events(spark, d)).withColumn("level", F.col("level").cast("bigint")), "date", "model", "level")


@query("SELECT date, round(sum(CASE WHEN model = 'purchase' THEN round(value / 100, 6) END), 4) AS credits, CAST(sum(CASE WHEN model = 'click' THEN 1 END) AS BIGINT) AS message_count FROM e GROUP BY date")
def nullable_credits(spark, d):
    return report.period_report(events(spark, d), breakdown=False).select("date", money("credits").alias("credits"), "message_count")


@query("SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS in_out_tokens, round(sum(cost), 4) AS cost, count(*) AS records, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(DISTINCT project) AS projects FROM e")
def daemon_snapshot(spark, d):
    s = report.snapshot(events(spark, d))
    return s.select("input_tokens", "output_tokens", "in_out_tokens", money("cost").alias("cost"), "records", F.array_join("models", ",").alias("models"), F.size("projects").cast("bigint").alias("projects"))


# Filters.


@query(f"SELECT date, {_SUMS} FROM e WHERE date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY date")
def date_range(spark, d):
    return sums(report.period_report(report.filter_dates(events(spark, d), "2024-01-05", "20240120"), breakdown=False), "date")


@query(f"SELECT date, {_SUMS} FROM e GROUP BY date HAVING bool_or(contains(lower(model), 'sign'))")
def model_filter(spark, d):
    return sums(report.filter_models(report.period_report(events(spark, d), breakdown=False), "SIGN"), "date")


@query(f"SELECT date, {_SUMS} FROM e WHERE project = 'p3' GROUP BY date")
def project_filter(spark, d):
    return sums(report.period_report(events(spark, d).where(F.col("project") == "p3"), breakdown=False), "date")


@query(f"SELECT date, {_SUMS} FROM e GROUP BY date ORDER BY date DESC")
def report_desc(spark, d):
    return sums(report.sort_report(report.period_report(events(spark, d), breakdown=False), "desc"), "date")


@query("SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d') AS date, count(*) AS records FROM events GROUP BY 1")
def tz_daily(spark, d):
    return report.period_report(events_usage(spark, d, "Asia/Tokyo"), breakdown=False).select("date", "records")


@query("SELECT DISTINCT model FROM e WHERE missing AND model IS NOT NULL")
def missing_warnings(spark, d):
    return report.missing_models(report.period_report(events(spark, d)))


@query("SELECT event_id, v AS version FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1.2.3' WHEN 1 THEN '1.2.3-beta' WHEN 2 THEN '1.2' WHEN 3 THEN 'v1.2.3' WHEN 4 THEN 'not-semver' END AS v FROM events) WHERE v IS NULL OR regexp_matches(v, '^[0-9]+\\.[0-9]+\\.[0-9]')")
def valid_version_filter(spark, d):
    v = F.element_at(F.array(F.lit("1.2.3"), F.lit("1.2.3-beta"), F.lit("1.2"), F.lit("v1.2.3"), F.lit("not-semver"), F.lit(None).cast("string")), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", v.alias("version")).where(text.is_version(F.col("version")))


# JSON and aliases.


@query("SELECT model, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) FILTER (input_tokens = 0) AS empty FROM e GROUP BY model")
def json_tokens(spark, d):
    return events_usage(spark, d).groupBy("model").agg(F.sum("input_tokens").alias("tokens"), F.count_if(F.col("input_tokens") == 0).alias("empty"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN input_tokens ELSE 0 END, 0), CASE WHEN event_id % 3 = 1 THEN input_tokens END, output_tokens, 0) AS input_tokens, least(output_tokens, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN input_tokens ELSE 0 END, 0), CASE WHEN event_id % 3 = 1 THEN input_tokens END, output_tokens, 0)) AS cached_tokens FROM e0")
def alias_coalesce(spark, d):
    """The rule of Codex's headless usages over its own struct: input_tokens, else prompt_tokens, else input."""
    u = events_usage(spark, d).withColumn("event_id", F.col("row_id"))
    given = {"input_tokens": F.when(F.col("event_id") % 3 == 0, F.col("input_tokens")).otherwise(0), "prompt_tokens": F.when(F.col("event_id") % 3 == 1, F.col("input_tokens")), "input": F.col("output_tokens"), "cached_tokens": F.col("output_tokens")}
    names = [f.split(":")[0].strip() for f in _CODEX_USAGE.removeprefix("struct<").rstrip(">").replace("\n", " ").split(",")]
    own = u.withColumn("u", F.struct(*[given.get(n, F.lit(None)).cast("bigint").alias(n) for n in names]))
    normal = codex._normal("u")
    return own.select("event_id", normal["input_tokens"].alias("input_tokens"), F.least(normal["cached_input_tokens"], normal["input_tokens"]).alias("cached_tokens"))


# Deduplication.


@query("SELECT message_id, request_id, row_id, total FROM (SELECT CAST(user_id AS VARCHAR) AS message_id, model AS request_id, event_id AS row_id, input_tokens + output_tokens AS total, row_number() OVER (PARTITION BY user_id, model ORDER BY input_tokens + output_tokens DESC, event_id) AS n FROM e0) WHERE n = 1")
def dedup_best(spark, d):
    u = events_usage(spark, d).withColumn("message_id", F.col("session_id")).withColumn("request_id", F.col("model"))
    return dedup.best_records(u, ("row_id",)).select("message_id", "request_id", "row_id", dedup.total_tokens().alias("total"))


@query("SELECT session_id, row_id FROM (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_orderkey * 10 + l_linenumber AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def dedup_first_wins(spark, d):
    return dedup.first_wins(lineitem_usage(spark, d), "session_id", [F.col("row_id").desc()]).select("session_id", "row_id")


@query("SELECT scope, rel, priority FROM (SELECT user_id % 3 AS scope, model AS rel, event_id AS priority, row_number() OVER (PARTITION BY user_id % 3, model ORDER BY event_id) AS n FROM e0) WHERE n = 1")
def file_priority_dedup(spark, d):
    files = table(spark, d, "events").select((F.col("user_id") % 3).alias("scope"), F.col("event_type").alias("rel"), F.col("event_id").alias("priority"))
    return dedup.files_first(files, ["scope", "rel"], "priority")


@query("SELECT DISTINCT epoch_us(ts) // 1000 AS ms, model, input_tokens, output_tokens FROM e0")
def event_dedup(spark, d):
    u = events_usage(spark, d).withColumn("cached_tokens", F.lit(0)).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return dedup.distinct_events(u.unionByName(u)).select(F.unix_millis("ts").alias("ms"), "model", "input_tokens", "output_tokens")


@query()
def sidechain_fold(spark, d):
    u = events_usage(spark, d).withColumn("message_id", (F.col("row_id") % 500).cast("string")).withColumn("request_id", F.concat(F.lit("r"), (F.col("row_id") % 3).cast("string"))).withColumn("is_sidechain", F.col("row_id") % 4 == 0)
    return dedup.best_records(u, ("row_id",)).select("message_id", "request_id", "is_sidechain", "row_id", dedup.total_tokens().alias("total"))


# Prices.


@query("SELECT event_id, round(cost, 8) AS cost FROM e")
def price_exact(spark, d):
    return events(spark, d).select(F.col("row_id").alias("event_id"), money("cost", 8).alias("cost"))


_FUZZY = ["us.anthropic.claude-opus-4-6-v1:0", "anthropic/claude-sonnet-4.5", "claude-3-opus-20240229", "claude-sonnet-4-20250514", "gpt-5.1-codex-max", "gpt-5.9", "glm-4.5v", "gpt-5.3-spark", "", "openai/gpt-5"]
_FUZZY_KEYS = ["claude-opus-4-6", "claude-opus-4", "claude-sonnet-4-5", "claude-sonnet-4", "claude-3-opus", "gpt-5", "gpt-5.1-codex", "gpt-5.1", "zai/glm-4.5v", "glm-4.5", "gpt-5.3-codex"]


def _fuzzy_sql() -> str:
    names = ", ".join(f"({k}, '{m}')" for k, m in enumerate(_FUZZY))
    keys = ", ".join(f"('{k}')" for k in _FUZZY_KEYS)
    esc = lambda c: f"regexp_replace({c}, '([^A-Za-z0-9])', '\\\\\\1', 'g')"
    occurs = lambda k, v: f"regexp_matches({v}, '(^|[^A-Za-z0-9])' || {esc(k)} || CASE WHEN regexp_matches({k}, '[0-9]$') THEN '($|[^A-Za-z0-9.-]|[.-]($|[^0-9]))' ELSE '($|[^A-Za-z0-9])' END)"
    a, b = "translate(n.name, '.@', '--')", "translate(k.key, '.@', '--')"
    return f"""n0(i, model) AS (VALUES {names}), k(key) AS (VALUES {keys}),
n AS (SELECT i, model, 0 AS turn, model AS name FROM n0 WHERE model <> '' UNION ALL SELECT i, model, 1, 'gpt-5.3-codex-spark' FROM n0 WHERE model = 'gpt-5.3-spark'),
m AS (SELECT n.i, n.model, n.turn, CASE WHEN n.name = k.key THEN 0 ELSE 1 END AS fuzzy, k.key FROM n JOIN k ON n.name = k.key OR {occurs('k.key', 'n.name')} OR {occurs('n.name', 'k.key')} OR {occurs(b, a)} OR {occurs(a, b)}),
r AS (SELECT i, model, key FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY turn, fuzzy, length(key) DESC, key) AS q FROM m) WHERE q = 1)
SELECT e0.event_id, n0.model, r.key FROM e0 JOIN n0 ON n0.i = e0.event_id % {len(_FUZZY)} LEFT JOIN r ON r.i = n0.i"""


@query()
def price_fuzzy_longest(spark, d):
    keys = pricing.price_table(spark.createDataFrame([(k, 1.0, 1.0) for k in _FUZZY_KEYS], "model string, input double, output double"))
    name = F.element_at(F.array(*[F.lit(m) for m in _FUZZY]), (F.col("event_id") % len(_FUZZY) + 1).cast("int"))
    own = table(spark, d, "events").select("event_id", name.alias("model"))
    return own.select("event_id", "model", pricing.price_key(F.col("model"), list(pricing.small_table(keys))).alias("key"))


_SQL["price_fuzzy_longest"] = f"WITH {_COMMON}, {_fuzzy_sql()}"


@query(
    """, p AS (SELECT p_partkey AS i FROM part)
SELECT i AS part, CASE i % 4 WHEN 0 THEN 'v' || (i % 7) || '-part-' || i WHEN 1 THEN 'us/v' || (i % 7) || '.part@' || i || ':beta' WHEN 2 THEN 'part.' || i ELSE 'part-' || i || '-pro' END AS model,
CASE WHEN i % 4 < 3 THEN 'v' || (i % 7) || '-part-' || i WHEN i % 5 = 0 THEN 'part-' || i END AS key FROM p"""
)
def price_index(spark, d):
    """As many price keys as there are parts, and some more, against as many models, through the index of words."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"))
    own = F.concat(F.lit("v"), F.col("part") % 7, F.lit("-part-"), F.col("part"))
    names = p.select(own.alias("model")).unionByName(p.where("part % 5 = 0").select(F.concat(F.lit("part-"), F.col("part")).alias("model")))
    keys = pricing.price_table(names.withColumns({"input": F.lit(1.0), "output": F.lit(1.0)}))
    k = F.col("part") % 4
    model = F.when(k == 0, own).when(k == 1, F.concat(F.lit("us/v"), F.col("part") % 7, F.lit(".part@"), F.col("part"), F.lit(":beta"))).when(k == 2, F.concat(F.lit("part."), F.col("part"))).otherwise(F.concat(F.lit("part-"), F.col("part"), F.lit("-pro")))
    models = p.select("part", model.alias("model"))
    return models.join(pricing.unsent(pricing.resolve(models.select("model"), keys)), "model", "left").select("part", "model", "key")


@query("SELECT model, count(*) AS records FROM e WHERE missing AND model IS NOT NULL GROUP BY model")
def price_missing(spark, d):
    return events(spark, d).where("missing_pricing_model IS NOT NULL").groupBy(F.col("missing_pricing_model").alias("model")).agg(F.count("*").alias("records"))


_CANDIDATES = [("claude-sonnet-4.5", "anthropic"), ("k2p6", "moonshot-ai"), ("claude-opus-45", "unknown"), ("nothing", "none")]


@query(
    """, c(i, key, rate) AS (VALUES (0, 'claude-sonnet-4-5', 3e-6), (1, 'moonshot_ai/kimi-k2.6', 2e-6), (2, 'claude-opus-4-5', 5e-6))
SELECT e0.event_id, round(coalesce(CASE WHEN event_id % 5 = 0 THEN 0.25 END, (input_tokens + output_tokens) * rate, 0), 8) AS cost FROM e0 LEFT JOIN c ON c.i = e0.event_id % 4"""
)
def price_candidates(spark, d):
    keys = [("claude-sonnet-4-5", 3e-6), ("moonshot_ai/kimi-k2.6", 2e-6), ("claude-opus-4-5", 5e-6)]
    p = pricing.price_table(spark.createDataFrame([(m, r, r, 1.0) for m, r in keys], "model string, input double, output double, multiplier double"))
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in _CANDIDATES]), (F.col("row_id") % 4 + 1).cast("int"))
    u = events_usage(spark, d).withColumn("price_model", pick(0)).withColumn("provider", pick(1)).withColumn("logged_cost", F.when(F.col("row_id") % 5 == 0, 0.25))
    return pricing.price_by_candidates(u, p).select(F.col("row_id").alias("event_id"), money("cost", 8).alias("cost"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, round(CASE WHEN t <= 200000 THEN t * 1e-6 ELSE 0.2 + (t - 200000) * 2e-6 END, 6) AS cost FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10000 AS t FROM lineitem)")
def tiered_cost(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("bigint") * 10_000).alias("t"))
    return li.select("k", "line", money(pricing.tiered(F.col("t"), F.lit(1e-6), F.lit(2e-6)), 6).alias("cost"))


@query("SELECT event_id, round(CASE WHEN model = 'purchase' AND event_id % 2 = 1 THEN (input_tokens * 5 + output_tokens * 25) / 1e6 ELSE cost END, 8) AS cost FROM e")
def fast_multiplier_cost(spark, d):
    u = events_usage(spark, d).withColumn("speed", F.when(F.col("row_id") % 2 == 0, "fast").otherwise("standard"))
    return pricing.price_usage(u, prices(spark), fast_multiplier_when="when_fast").select(F.col("row_id").alias("event_id"), money("cost", 8).alias("cost"))


@query("SELECT event_id, round(coalesce((greatest(t - least(input_tokens, t), 0) * i + least(input_tokens, t) * CASE model WHEN 'click' THEN 0.5e-6 WHEN 'view' THEN 0.1e-6 WHEN 'purchase' THEN 0.5e-6 ELSE 0.3e-6 END + output_tokens * o), 0), 8) AS cost FROM (SELECT e0.*, input_tokens + output_tokens AS t, i, o FROM e0 LEFT JOIN prices USING (model))")
def cached_cost(spark, d):
    u = events_usage(spark, d).withColumn("cached_tokens", F.col("input_tokens")).withColumn("input_tokens", F.col("input_tokens") + F.col("output_tokens"))
    u = u.withColumn("cached_tokens", F.least("cached_tokens", "input_tokens"))
    return pricing.with_prices(u, prices(spark)).select(F.col("row_id").alias("event_id"), money(pricing.cached_cost("price_"), 8).alias("cost"))


@query("SELECT DISTINCT model, CASE model WHEN 'click' THEN 200000 WHEN 'view' THEN 1000000 END AS context_limit FROM e0 WHERE model IN ('click', 'view')")
def context_limits(spark, d):
    p = prices(spark).withColumn("context_limit", F.when(F.col("model") == "click", 200_000).when(F.col("model") == "view", 1_000_000).cast("bigint"))
    return pricing.context_limits(table(spark, d, "events").select(F.col("event_type").alias("model")), p).select("model", F.col("context_limit").cast("int").alias("context_limit"))


_REVIEW_SQL = "CASE " + " ".join(f"WHEN day >= '{a}' THEN '{b}'" for a, b in sorted(sequence.REVIEW_FALLBACKS, reverse=True)) + " ELSE 'gpt-5' END"


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_REVIEW_SQL} ELSE model END AS model FROM (SELECT event_id, model, strftime(ts + to_days(CAST(event_id % 900 AS INTEGER)), '%Y-%m-%d') AS day FROM e0)")
def asof_model(spark, d):
    u = events_usage(spark, d)
    day = F.date_format(F.date_add(F.to_date("ts"), (F.col("row_id") % 900).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    model = F.when(F.col("row_id") % 2 == 0, sequence.REVIEW_MODEL).otherwise(F.col("model"))
    return u.select(F.col("row_id").alias("event_id"), sequence.review_model(model, day).alias("model"))


# Sequences.


@query("SELECT event_id, greatest(input_tokens - coalesce(lag(input_tokens) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 0) AS delta FROM e0")
def cumulative_delta(spark, d):
    return sequence.cumulative_delta(events_usage(spark, d), "input_tokens", "delta", ["session_id"], ["ts", "row_id"]).select(F.col("row_id").alias("event_id"), "delta")


@query("SELECT event_id, coalesce(last_value(CASE WHEN model IN ('view', 'click') THEN model END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'gpt-5') AS model FROM e0")
def carry_forward_model(spark, d):
    u = events_usage(spark, d).withColumn("told", F.when(F.col("model").isin("view", "click"), F.col("model")))
    return sequence.carry_forward(u, "told", "carried", ["session_id"], ["ts", "row_id"], "gpt-5").select(F.col("row_id").alias("event_id"), F.col("carried").alias("model"))


@query(
    """, s AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H') AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e0),
f AS (SELECT user_id, CASE WHEN max(CASE WHEN n = 1 THEN sec END) = max(CASE WHEN n = 2 THEN sec END) THEN max(CASE WHEN n = 1 THEN sec END) END AS r FROM s GROUP BY user_id),
x AS (SELECT s.user_id, min(n) AS stop FROM s JOIN f USING (user_id) WHERE sec <> r GROUP BY s.user_id)
SELECT s.event_id, coalesce(s.sec = f.r AND (x.stop IS NULL OR s.n < x.stop), false) AS replayed FROM s JOIN f USING (user_id) LEFT JOIN x USING (user_id)"""
)
def replay_skip(spark, d):
    u = events_usage(spark, d)
    flagged = sequence.replay_flag(u, F.date_format("ts", "yyyy-MM-dd'T'HH"), F.lit(True), ["session_id"], ["ts", "row_id"])
    return flagged.select(F.col("row_id").alias("event_id"), "replayed")


# Blocks: a gap of more than 30 minutes ends a user's block; the global ones use 3 minutes.

_BLOCKS = """, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {k} ORDER BY ts, event_id)) > {us} THEN 1 WHEN lag(ts) OVER (PARTITION BY {k} ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS f FROM e),
h AS (SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM g),
blk AS (SELECT {k} AS k, b, min(ts) AS block_start, max(ts) AS block_end, count(*) AS records, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, sum(cost) AS cost, string_agg(DISTINCT model, ',' ORDER BY model) AS models, b = max(b) OVER (PARTITION BY {k}) AS is_active FROM h GROUP BY {k}, b)
"""
_GLOBAL, _BY_USER = _BLOCKS.format(k="(user_id * 0)", us=180_000_000), _BLOCKS.format(k="user_id", us=43_200_000_000)


def global_blocks(spark, d):
    return blocks.activity_blocks(events(spark, d), session_seconds=180)


def ntz(*cs: str) -> list[Column]:
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in cs]


@query(_GLOBAL + "SELECT block_start, block_end, records, tokens, round(cost, 6) AS cost, models, is_active, CASE WHEN NOT is_active THEN block_end END AS actual_end FROM blk")
def activity_blocks(spark, d):
    return global_blocks(spark, d).select(*ntz("block_start", "block_end"), "records", "tokens", money("cost", 6).alias("cost"), F.array_join("models", ",").alias("models"), "is_active", *ntz("actual_end"))


@query(_BY_USER + "SELECT CAST(k AS VARCHAR) AS session_id, block_start, block_end, records, tokens, round(cost, 6) AS cost, is_active FROM blk")
def user_blocks(spark, d):
    b = blocks.activity_blocks(events(spark, d), ["session_id"], 43_200)
    return b.select("session_id", *ntz("block_start", "block_end"), "records", "tokens", money("cost", 6).alias("cost"), "is_active")


@query(_GLOBAL + "SELECT gap_start, gap_end FROM (SELECT block_end AS gap_start, lead(block_start) OVER (ORDER BY b) AS gap_end FROM blk) WHERE epoch_us(gap_end) - epoch_us(gap_start) > 360000000")
def block_gaps(spark, d):
    return blocks.gap_rows(global_blocks(spark, d), session_seconds=180).select(*ntz("gap_start", "gap_end"))


_MINUTES = "greatest((epoch_us(block_end) - epoch_us(block_start)) / 60000000.0, 0.1)"


@query(_GLOBAL + f"SELECT block_start, round(tokens / {_MINUTES}, 4) AS tokens_per_minute, round(cost / {_MINUTES} * 60, 6) AS cost_per_hour FROM blk")
def burn_rate(spark, d):
    return blocks.burn_rate(global_blocks(spark, d)).select(*ntz("block_start"), money("tokens_per_minute").alias("tokens_per_minute"), money("cost_per_hour", 6).alias("cost_per_hour"))


@query(_GLOBAL + f"SELECT block_start, CASE WHEN tokens <= 0 OR tokens >= 5000 THEN 0 ELSE CAST(floor((5000 - tokens) / (tokens / {_MINUTES})) AS BIGINT) END AS remaining_minutes FROM blk")
def limit_projection(spark, d):
    return blocks.projection(global_blocks(spark, d), text.token_limit("5K")).select(*ntz("block_start"), "remaining_minutes")


@query(_GLOBAL + "SELECT block_start, tokens, round(cost, 6) AS cost, models FROM blk WHERE is_active")
def active_block(spark, d):
    return global_blocks(spark, d).where("is_active").select(*ntz("block_start"), "tokens", money("cost", 6).alias("cost"), F.array_join("models", ",").alias("models"))


# Unions.


@query(
    """, u AS (SELECT date, 'events' AS agent, cost, input_tokens + output_tokens AS t FROM e
UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%d'), 'lineitem', l_extendedprice, CAST(l_quantity AS BIGINT) + CAST(l_quantity * 2 AS BIGINT) FROM lineitem
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), 'orders', o_totalprice, 1 + CAST(floor(o_totalprice / 1000) AS BIGINT) FROM orders)
SELECT date, agent, round(sum(cost), 2) AS cost, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) AS records FROM u GROUP BY 1, 2"""
)
def all_sources_union(spark, d):
    r = report.all_agents([events(spark, d), lineitem_usage(spark, d), orders_usage(spark, d)], breakdown=False)
    return r.select("date", "agent", money("cost", 2).alias("cost"), "total_tokens", "records")


# Text.


@query("SELECT DISTINCT 'bedrock/us.anthropic.' || p_brand AS raw, p_brand AS short FROM part")
def short_names(spark, d):
    raw = F.concat(F.lit("bedrock/us.anthropic."), "p_brand")
    return table(spark, d, "part").select(raw.alias("raw"), text.short_model(raw).alias("short")).distinct()


_HUMAN = """CASE WHEN n >= 1000000 THEN regexp_replace(CASE WHEN n / 1e6 >= 100 THEN printf('%.0f', n / 1e6) WHEN n / 1e6 >= 10 THEN printf('%.1f', n / 1e6) ELSE printf('%.2f', n / 1e6) END, '\\.0$', '') || 'M'
WHEN n >= 10000 THEN regexp_replace(CASE WHEN n / 1e3 >= 100 THEN printf('%.0f', n / 1e3) ELSE printf('%.1f', n / 1e3) END, '\\.0$', '') || 'K' WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END"""


@query(f"SELECT o_orderkey, {_HUMAN} AS human FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 7) AS n FROM orders)")
def human_numbers(spark, d):
    n = F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 7)
    return table(spark, d, "orders").select("o_orderkey", text.human_number(n).alias("human"))


@query("SELECT l_orderkey, l_linenumber, printf('$%.2f', CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 4) AS price FROM lineitem")
def currency_text(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.currency(F.col("l_quantity").cast("bigint").cast("double") / 4).alias("price"))


@query("SELECT user_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END AS span FROM (SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS s FROM events GROUP BY user_id)")
def duration_texts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").agg(F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000).cast("bigint").alias("s"))
    return e.select("user_id", dates.duration_text(F.col("s")).alias("span"))


# Streams, run over all that is there.


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.lit("events").alias("agent"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("user_id").cast("string").alias("user"), F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("request_id"), F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("input_tokens"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("output_tokens"), F.coalesce("value", F.lit(0.0)).alias("cost"))


def _drained(spark, df, mode):
    name = f"stream_{uuid.uuid4().hex}"
    return live.run_to_table(df, mode, name, f"{scratch(spark)}/{name}")


@query("SELECT date, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(value), 2) AS cost FROM e0 GROUP BY date")
def stream_daily(spark, d):
    return _drained(spark, live.daily(_stream(spark, d)), "complete").select("date", "records", "input_tokens", money("cost", 2).alias("cost"))


@query("SELECT count(*) AS records, count(DISTINCT message_id) AS messages FROM (SELECT CAST(event_id AS VARCHAR) AS message_id FROM events)")
def stream_dedup(spark, d):
    out = _drained(spark, live.deduplicated(_stream(spark, d), watermark="60 days"), "append")
    return out.agg(F.count("*").alias("records"), F.count_distinct("message_id").alias("messages"))


@query(_BLOCKS.format(k="(user_id * 0)", us=3_600_000_000) + "SELECT count(*) AS blocks, CAST(sum(records) AS BIGINT) AS records FROM blk")
def stream_blocks(spark, d):
    out = _drained(spark, live.blocks(_stream(spark, d), gap="1 hour", watermark="60 days"), "complete")
    return out.agg(F.count("*").alias("blocks"), F.sum("records").alias("records"))


from tokentally import log_queries  # noqa: E402  registers its queries with the decorator above

_SQL["sidechain_fold"] = _SQL["stream_side_chain"] = log_queries.SIDECHAIN_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _SQL.items() if k in _QUERIES}
