from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tokentally.functions import dates, text


def one(spark, column, *values):
    """The column's value over one row (v0, v1, ...)."""
    df = spark.createDataFrame([tuple(values) or (0,)], [f"v{i}" for i in range(max(1, len(values)))])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("2025-01-10T10:00:00.000Z", "2025-01-10 10:00:00"), ("2025-01-10T10:00:00", "2025-01-10 10:00:00"), ("2024-08-05T08:30:00+09:00", "2024-08-04 23:30:00"), ("2024-08-04", None), ("2024-08-04 10:00:00", None), ("junk", None), ("2024-13-40T10:00:00Z", None)])
def test_parse_timestamp(spark, value, want):
    assert one(spark, dates.parse_timestamp(F.col("v0")).cast("string"), value) == want


def test_zones(spark):
    ts = dates.parse_timestamp(F.col("v0"))
    assert one(spark, dates.date_in_zone(ts, "Asia/Tokyo"), "2024-08-04T23:30:00Z") == "2024-08-05"
    assert [dates.zone(z) for z in (None, "", "Nowhere/None", "America/New York", "Asia/Tokyo")] == ["UTC", "UTC", "UTC", "America/New_York", "Asia/Tokyo"]


@pytest.mark.parametrize(("start", "want"), [("sunday", "2023-12-31"), ("monday", "2024-01-01"), ("Wednesday", "2024-01-03"), ("thursday", "2023-12-28"), ("nonsense", "2024-01-01")])
def test_weeks(spark, start, want):
    assert one(spark, dates.bucket(F.col("v0"), "weekly", start), "2024-01-03") == want


def test_buckets(spark):
    assert one(spark, dates.bucket(F.col("v0"), "monthly"), "2025-06-15") == "2025-06"
    assert one(spark, dates.bucket(F.col("v0"), "weekly"), "no date") == "no date"
    assert one(spark, dates.bucket(F.col("v0"), "daily"), "2025-06-15") == "2025-06-15"


@pytest.mark.parametrize(("value", "want"), [("2025-01-10T10:00:00Z", "2025-01-10T10:00:00Z"), (" 2025-01-10 x", "2025-01-10 x"), ("1736503200", "2025-01-10T10:00:00.000Z"), ("1736503200123", "2025-01-10T10:00:00.123Z"), ("0", None), ("", None), ("soon", None)])
def test_flexible_timestamps(spark, value, want):
    assert one(spark, dates.flexible_timestamp(F.col("v0")), value) == want


def test_bounds(spark):
    assert [dates.bound(b) for b in ("2025-02-01", "2025-02-01 10:00", "2025-02-01 10:00:05", "20250201", "", None)] == ["20250201"] * 4 + [None, None]
    keep = [one(spark, dates.in_range(F.col("v0"), "20250201", "2025-02-28"), d) for d in ("2025-01-31", "2025-02-01", "2025-02-28", "2025-03-01")]
    assert keep == [False, True, True, False]


@pytest.mark.parametrize(("seconds", "short", "long"), [(30, "30s", "30s"), (300, "5m", "5m0s"), (5400, "1h30m", "1h30m")])
def test_durations(spark, seconds, short, long):
    assert one(spark, dates.duration_text(F.col("v0")), seconds) == short
    assert one(spark, dates.duration_long(F.col("v0")), seconds) == long


@pytest.mark.parametrize(("n", "want"), [(0, "0"), (999, "999"), (1234, "1,234"), (9999, "9,999"), (10_000, "10K"), (12_345, "12.3K"), (123_456, "123K"), (846_500, "846K"), (847_500, "848K"), (47_650, "47.6K"), (1_234_567, "1.23M"), (1_000_000_000, "1.00B")])
def test_human_numbers(spark, n, want):
    assert one(spark, text.human_number(F.col("v0")), n) == want


@pytest.mark.parametrize(("x", "want"), [(0.25, "$0.25"), (0.125, "$0.12"), (0.375, "$0.38"), (1.005, "$1.00"), (-2.5, "$-2.50"), (1234.5, "$1234.50")])
def test_currency(spark, x, want):
    assert one(spark, text.currency(F.col("v0")), x) == want


def test_models(spark):
    names = ["us.anthropic.claude-opus-4-6", "openrouter/anthropic/claude-sonnet-4", "bedrock/us.anthropic.x", "gpt-5", "openai/gpt-5"]
    assert [one(spark, text.short_model(F.col("v0")), m) for m in names] == ["claude-opus-4-6", "claude-sonnet-4", "x", "gpt-5", "gpt-5"]
    assert one(spark, text.model_list(F.col("v0")), names[3:] + ["a"]) == "- a\n- gpt-5"


def test_versions(spark):
    assert [one(spark, text.is_version(F.col("v0")), v) for v in ("1.2.3", "1.2.3-beta", "1.2", "v1.2.3", "not-semver")] == [True, True, False, False, False]


def test_guards(spark):
    lines = ['{"speed":null}', '{"content":null}', '{"sessionId": null}', '{"a":1}']
    assert [one(spark, text.null_guard(F.col("v0")), x) for x in lines] == [False, True, True, True]
    assert one(spark, F.unix_timestamp(text.usage_limit_reset(F.col("v0"))), "Claude AI usage limit reached|1736503200") == 1736503200
    assert one(spark, text.usage_limit_reset(F.col("v0")), "nothing here") is None


def test_small_things(spark):
    assert [text.token_limit(t) for t in ("500K", "2M", "1000", "", None, "x", "0")] == [500_000, 2_000_000, 1000, 500_000, 500_000, 500_000, 500_000]
    assert text.parse_aliases("a=b, c = d,bad") == {"a": "b", "c": "d"}
    assert one(spark, text.project_name(F.col("v0"), {"/x/y": "Y"}), "/x/y") == "Y"
    assert one(spark, text.project_name(F.col("v0"), {"c:/x": "X"}), "c:\\x") == "X"
    assert one(spark, text.project_name(F.col("v0")), "c:\\x\\proj") == "proj"
    assert [one(spark, text.truncate_9(F.col("v0")), x) for x in (1.1234567899, -1.1234567899, float("nan"), float("inf"))] == [1.123456789, -1.123456789, 0.0, 0.0]
    assert text.agent_name("codex") == "Codex CLI"
    assert one(spark, text.first_filled(F.col("v0"), F.col("v1")), "  ", " b ") == "b"
