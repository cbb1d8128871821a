from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tokentally.plans import pricing
from tokentally.schema import canonical


def resolved(spark, models, keys, **kw):
    p = pricing.price_table(spark.createDataFrame([(k, 1.0, 1.0) for k in keys], "model string, input double, output double"))
    rows = pricing.resolve(spark.createDataFrame([(m,) for m in models], "model string"), p, **kw).collect()
    return {r.model: r.key for r in rows}


def test_matching(spark):
    keys = list(pricing._BUILT_IN) + ["claude-sonnet-4-5", "gpt-5-codex", "gpt-4-turbo-xyz"]
    got = resolved(spark, ["us.anthropic.claude-opus-4-6-v1:0", "anthropic/claude-sonnet-4.5", "claude-3-opus-20240229", "claude-sonnet-4-20250514", "claude-opus-4-5-20251101", "gpt-5.1-codex-max", "gpt-5.9", "glm-4.5v", "", None, "gpt-5", "gpt-5.3-spark"], keys)
    assert got == {"us.anthropic.claude-opus-4-6-v1:0": "claude-opus-4-6", "anthropic/claude-sonnet-4.5": "claude-sonnet-4-5", "claude-3-opus-20240229": "claude-3-opus", "gpt-5.1-codex-max": "gpt-5.1-codex", "glm-4.5v": "zai/glm-4.5v", "gpt-5": "gpt-5", "gpt-5.3-spark": "gpt-5.3-codex"}
    assert "claude-sonnet-4-20250514" not in got
    assert resolved(spark, ["claude-sonnet-4-20250514"], keys, match_dated_models=True) == {"claude-sonnet-4-20250514": "claude-sonnet-4"}


def test_matching_within_the_record(spark, monkeypatch):
    """The expression, and the pass over distinct models that larger tables take, find what resolve() finds."""
    keys = list(pricing._BUILT_IN) + ["claude-sonnet-4-5", "gpt-5-codex", "gpt-5.3-codex-spark", "a.b", "a-c@1"]
    names = ["us.anthropic.claude-opus-4-6-v1:0", "anthropic/claude-sonnet-4.5", "claude-3-opus-20240229", "claude-sonnet-4-20250514", "gpt-5.1-codex-max", "gpt-5.9", "glm-4.5v", "", None, "gpt-5", "gpt-5.3-spark", "GPT-5", "x.b", "z/a.c.1", "5", "opus"]
    df = spark.createDataFrame([(m,) for m in names], "m string")
    for dated in (False, True):
        want = resolved(spark, names, keys, match_dated_models=dated)
        got = {r.m: r.k for r in df.select("m", pricing.price_key(F.col("m"), keys, dated).alias("k")).collect()}
        assert {m: k for m, k in got.items() if k} == want
    u = usage(spark, [(m, 1000) for m in names], "price_model string, input_tokens long")
    cost = lambda: sorted(map(repr, ((r.price_model, r.cost, r.missing_pricing_model) for r in pricing.price_usage(u, pricing.built_in(spark)).collect())))
    records = usage(spark, [("claude-sonnet-4.5", 10), ("k2p6", 10), ("nothing", 10)], "price_model string, input_tokens long").withColumn("provider", F.lit("anthropic"))
    listed = lambda: sorted((r.price_model, r.cost) for r in pricing.price_by_candidates(records, pricing.built_in(spark)).collect())
    small = cost(), listed()
    monkeypatch.setattr(pricing, "MATCHED_KEYS", 1)
    assert (cost(), listed()) == small
    assert pricing.with_prices(u, pricing.built_in(spark).limit(0)).where("price_known").count() == 0


def test_ties_are_alphabetical(spark):
    assert resolved(spark, ["gpt"], ["gpt-b", "gpt-a", "gpt-c"]) == {"gpt": "gpt-a"}


def usage(spark, rows, schema):
    return canonical(spark.createDataFrame(rows, schema))


def test_cost_of_a_record(spark):
    u = usage(spark, [("claude-sonnet-4-6", 100, 50, 10, 5), ("none", 1, 1, 0, 0), ("", 1, 1, 0, 0), (None, 1, 1, 0, 0)], "price_model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long")
    got = {r.price_model: (r.cost, r.missing_pricing_model) for r in pricing.price_usage(u, pricing.built_in(spark)).collect()}
    assert got["claude-sonnet-4-6"][0] == pytest.approx(0.001089)
    assert got["none"] == (0.0, "none") and got[""] == (0.0, None) and got[None] == (0.0, None)


def test_tiers(spark):
    df = spark.createDataFrame([(300_000,), (200_000,), (0,)], "n long")
    got = [r.c for r in df.select(pricing.tiered(F.col("n"), F.lit(1e-6), F.lit(2e-6)).alias("c")).collect()]
    assert got == [pytest.approx(0.4), pytest.approx(0.2), 0]


def test_multipliers(spark):
    u = usage(spark, [("claude-opus-4-6", "standard", 1_000_000), ("claude-opus-4-6", "fast", 1_000_000)], "price_model string, speed string, input_tokens long")
    p = pricing.built_in(spark)
    assert sorted(r.cost for r in pricing.price_usage(u, p).collect()) == [30.0, 30.0]
    assert sorted(r.cost for r in pricing.price_usage(u, p, fast_multiplier_when="when_fast").collect()) == [5.0, 30.0]
    names = spark.createDataFrame([(m,) for m in ("gpt-5.5", "x/claude-opus-4.7:beta", "claude-opus-4-8-fast", "claude-opus-4-80", "gpt-5")], "m string")
    assert [r.x for r in names.select(pricing.fast_multiplier(F.col("m")).alias("x")).collect()] == [2.5, 6.0, 2.0, 0.0, 0.0]


def test_precedence(spark):
    u = usage(spark, [("gpt-5", 1_000_000, 0.05), ("gpt-5", 1_000_000, 0.0), ("gpt-5", 1_000_000, None), ("gpt-5", 1_000_000, -1.0)], "price_model string, input_tokens long, logged_cost double")
    cost = lambda how: sorted(r.cost for r in pricing.price_usage(u, pricing.built_in(spark), how).collect())
    assert cost("computed") == [1.25] * 4
    assert cost("logged") == [-1.0, 0.05, 1.25, 1.25]
    assert cost("positive") == [0.05, 1.25, 1.25, 1.25]


def test_sources_of_prices(spark, tmp_path):
    full = {"m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "max_input_tokens": 5}, "c": {"i": 1e-6, "o": 3e-6, "cr": 1e-7, "fast": 2}, "bad": {"i": 1e-6}}
    got = {r.model: r for r in pricing.from_litellm(spark, json.dumps(full)).collect()}
    assert set(got) == {"m", "c"} and got["m"].context_limit == 5 and got["c"].multiplier == 2 and got["c"].cache_read_explicit and got["m"].cache_create == pytest.approx(1.25e-6) and not got["m"].cache_read_explicit
    nested = {"p": {"models": {"k": {"id": "a", "cost": {"input": 1, "output": 2}, "limit": {"context": 9}}, "free": {}}}}
    flat = {"b": {"cost": {"input": 3, "output": 4, "cache_read": 1}}}
    assert [(r.model, r.input, r.context_limit) for r in pricing.from_models_dev(spark, json.dumps(nested)).collect()] == [("a", 1e-6, 9)]
    assert [(r.model, r.cache_read) for r in pricing.from_models_dev(spark, json.dumps(flat)).collect()] == [("b", 1e-6)]
    (tmp_path / "p.csv").write_text("model,input,output,cache_read\na,1,2,0.5\na,9,9,9\nb,3,4,\n")
    csv = pricing.from_csv(spark, str(tmp_path / "p.csv"))
    assert {r.model: (r.input, r.cache_read) for r in csv.collect()} == {"a": (1e-6, 5e-7), "b": (3e-6, pytest.approx(3e-7))}
    assert {(r.model, r.change) for r in pricing.price_changes(pricing.built_in(spark).where("model = 'gpt-5'"), csv).collect()} == {("gpt-5", "removed"), ("a", "added"), ("b", "added")}
    config = pricing.from_config(spark, '{"pricing": {"gpt-5": {"input": 2e-6, "output": 3e-6, "cacheCreation": 1e-6}, "new": {"input": 1e-6, "output": 1e-6, "contextLimit": 7}}}')
    both = {r.model: r for r in pricing.fill_missing(config, pricing.built_in(spark)).collect()}
    assert both["gpt-5"].input == 2e-6 and both["gpt-5"].cache_create == 1e-6 and both["new"].context_limit == 7 and both["claude-opus-4"].output == pytest.approx(75e-6) and len(both) == 45


def test_overrides(spark):
    base = pricing.price_table(spark.createDataFrame([("a", 1e-6, 2e-6, None), ("b", 1e-6, 2e-6, 5e-7)], "model string, input double, output double, cache_read double"))
    o = spark.createDataFrame([("a", 2e-6), ("b", 2e-6), ("c", 3e-6)], "model string, input double")
    got = {r.model: r for r in pricing.apply_overrides(base, o).collect()}
    assert got["a"].cache_read == pytest.approx(2e-7) and got["a"].cache_create == pytest.approx(2.5e-6)
    assert got["b"].cache_read == 5e-7 and got["b"].cache_create == pytest.approx(1.25e-6)
    assert got["c"].input == 3e-6 and got["c"].output == 0


def test_candidates(spark):
    df = spark.createDataFrame([("claude-sonnet-4.5", "anthropic"), ("claude-opus-45", "unknown"), ("k2p6", "moonshot-ai"), ("gemini-3-pro-high", "google"), ("claude-haiku-x", "a")], "m string, p string")
    assert [r.c for r in df.select(pricing.candidates(F.col("m"), F.col("p")).alias("c")).collect()] == [
        ["claude-sonnet-4.5", "claude-sonnet-4-5", "anthropic/claude-sonnet-4.5", "anthropic/claude-sonnet-4-5"],
        ["claude-opus-45", "claude-opus-4-5"],
        ["kimi-k2.6", "moonshot_ai/kimi-k2.6"],
        ["gemini-3-pro-preview", "google/gemini-3-pro-preview"],
        ["claude-haiku-x", "a/claude-haiku-x"],
    ]


def test_large_tables_are_matched_by_an_index(spark):
    """What comparing all pairs finds, without a nested loop in the plan."""
    import random

    from tokentally.plans import pricing

    rng = random.Random(5)
    words = ["gpt", "claude", "5", "4.5", "mini", "v2", "é", "opus", "20250101"]
    name = lambda: rng.choice(["", "us.", "-"]) + rng.choice("-./@: ").join(rng.choices(words, k=rng.randrange(1, 5)))
    keys = sorted({name() for _ in range(150)} | {"-", ".."})
    models = sorted({name() for _ in range(150)} | {"a - b", "--"})
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    m = spark.createDataFrame([(x,) for x in models], "name string")
    fits = pricing.matches(F.col("name"), F.col("key"))
    want = {tuple(r) for r in m.crossJoin(k).where(fits).collect()}
    found = pricing.candidate_pairs(m, k)
    rows = [tuple(r) for r in found.where(fits).collect()]
    assert set(rows) == want and len(rows) == len(want) > 100
    prices = pricing.price_table(k.select(F.col("key").alias("model"), F.lit(1.0).alias("input"), F.lit(1.0).alias("output")))
    for df in (pricing.resolve(m, prices), pricing.context_limits(m, prices.withColumn("context_limit", F.lit(5).cast("bigint")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_is_not_sent_to_executors(spark):
    """However few bytes the names shuffle, no side of the index is broadcast."""
    models = spark.range(2000).selectExpr("concat('us/part@', id) AS model")
    keys = pricing.price_table(spark.range(2000).selectExpr("concat('part-', id) AS model", "1.0 AS input", "1.0 AS output"))
    found = pricing.resolve(models, keys)
    assert {(r.model, r.key) for r in found.collect()} == {(f"us/part@{i}", f"part-{i}") for i in range(2000)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
