from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tokentally.operators import blocks, dedup, report, sequence
from tokentally.schema import canonical


def ts(minutes):
    return datetime.datetime(2025, 1, 10, 10) + datetime.timedelta(minutes=minutes)


def usage(spark, rows, schema):
    return canonical(spark.createDataFrame(rows, schema))


def fold(rows):
    """The ordered merge of one message's records, said plainly: (request, side, tokens, speed)."""
    kept = []

    def better(a, b):
        if a[1] != b[1]:
            return not a[1]
        if a[2] != b[2]:
            return a[2] > b[2]
        return a[3] is not None and b[3] is None

    for r in rows:
        at = next((i for i, k in enumerate(kept) if k[0] == r[0]), None)
        if at is None and r[1]:
            at = next((i for i, k in enumerate(kept) if k[1]), None)
        if at is None:
            kept.append(r)
        elif better(r, kept[at]):
            kept[at] = r
    return kept


@pytest.mark.parametrize("combine", [False, True])
def test_best_records(spark, combine):
    rng = random.Random(4)
    rows, want = [], set()
    for m in range(600):
        own = [(f"r{rng.randrange(4)}", rng.random() < 0.4, rng.randrange(1, 5), rng.choice([None, "fast"])) for _ in range(rng.randrange(1, rng.choice([4, 9, 30])))]
        rows += [(f"m{m}", *r, m * 100 + i) for i, r in enumerate(own)]
        want |= {(f"m{m}", *r) for r in fold(own)}
    rows += [(None, None, False, 1, None, 99990), (None, None, False, 1, None, 99991), ("", None, None, 1, None, 99992)]
    got = dedup.best_records(usage(spark, rows, "message_id string, request_id string, is_sidechain boolean, input_tokens long, speed string, row_id long"), ("row_id",), combine).collect()
    assert {(r.message_id, r.request_id, r.is_sidechain, r.input_tokens, r.speed) for r in got if r.message_id} == want
    assert sum(1 for r in got if not r.message_id) == 3


def test_best_records_scan_and_shuffle_once(spark, tmp_path):
    """One scan, one exchange, no Python; also where Claude's lines are parsed."""
    from tokentally.sources.claude import ClaudeSource

    u = usage(spark, [("m", "r", 1, 1)], "message_id string, request_id string, input_tokens long, row_id long")
    u.write.parquet(str(tmp_path / "u"))
    (tmp_path / "projects" / "p").mkdir(parents=True)
    (tmp_path / "projects" / "p" / "s.jsonl").write_text("{}\n")
    for df in (dedup.best_records(spark.read.parquet(str(tmp_path / "u"))), ClaudeSource().read(spark, paths=[str(tmp_path / "projects")])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count(" Exchange ") == 1 and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("combine", [False, True])
def test_message_of_many_requests(spark, combine):
    """Time and memory go with the records, not with their square: 100,000 requests of one message, with side chains in between."""
    n = 100_000
    rows = spark.range(2 * n).select(F.lit("m").alias("message_id"), F.concat(F.lit("r"), (F.col("id") % n).cast("string")).alias("request_id"), (F.col("id") % 1000 == 999).alias("is_sidechain"), F.lit(1).alias("input_tokens"), F.col("id").alias("row_id"))
    got = dedup.best_records(canonical(rows), ("row_id",), combine).agg(F.count("*"), F.count_if("is_sidechain"), F.sum("row_id")).first()
    kept = fold([(f"r{i % n}", i % 1000 == 999, 1, None) for i in range(2 * n) if i % 1000 in (998, 999)])
    others = n - n // 1000 * 2
    assert got[0] == others + len(kept) and got[1] == sum(k[1] for k in kept) == 1


def test_known_fold(spark):
    rows = [("m", "r1", True, 10, 0), ("m", "r2", True, 5, 1), ("m", "r1", False, 3, 2), ("m", "r9", False, 3, 3), ("m", "r2", True, 99, 4)]
    got = dedup.best_records(usage(spark, rows, "message_id string, request_id string, is_sidechain boolean, input_tokens long, row_id long"), ("row_id",)).collect()
    assert sorted((r.request_id, r.is_sidechain, r.input_tokens) for r in got) == [("r1", False, 3), ("r2", True, 99), ("r9", False, 3)]


def runs(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][-1] <= gap:
            out[-1].append(t)
        else:
            out.append([t])
    return [(r[0], r[-1], len(r)) for r in out]


def test_blocks(spark):
    rng = random.Random(2)
    times = {k: [rng.randrange(0, 5000) for _ in range(120)] for k in ("a", "b")}
    times["edge"] = [0, 30, 60, 91]
    u = usage(spark, [(k, ts(t), 1, 0.5, "m") for k in times for t in times[k]] + [("a", None, 1, 0.5, "m")], "agent string, ts timestamp, input_tokens long, cost double, model string")
    got = blocks.activity_blocks(u, ["agent"], 1800).collect()
    for k in times:
        own = sorted((r for r in got if r.agent == k), key=lambda r: r.block)
        assert [(r.block_start, r.block_end, r.records) for r in own] == [(ts(a), ts(b), n) for a, b, n in runs(times[k], 30)]
        assert [r.is_active for r in own] == [False] * (len(own) - 1) + [True] and own[-1].actual_end is None


def test_gap_rate_projection(spark):
    u = usage(spark, [(ts(0), 1000, 1.0), (ts(60), 5000, 2.0), (ts(180 + 60), 10, 0.0)], "ts timestamp, input_tokens long, cost double")
    b = blocks.activity_blocks(u, session_seconds=3600)
    assert [(r.gap_start, r.gap_end, r.gap_id) for r in blocks.gap_rows(b, session_seconds=3600).collect()] == [(ts(60), ts(240), "gap-2025-01-10T11:00:00Z")]
    first = blocks.projection(blocks.burn_rate(b), 30_000).orderBy("block").collect()
    assert first[0].tokens_per_minute == 100 and first[0].cost_per_hour == 3 and first[0].remaining_minutes == 240
    assert first[1].tokens_per_minute == 100  # a tenth of a minute at least
    assert blocks.projection(b, 5).orderBy("block").first().remaining_minutes == 0
    assert blocks.activity_blocks(u.limit(0)).count() == 0


def test_summaries(spark):
    rows = [("2025-06-10", "s1", "opus", 100, 50, 7, 0.5, 0.3, None), ("2025-06-10", "s1", "sonnet", 10, 5, 0, 0.9, 0.5, None), ("2025-06-12", "s2", "opus", 1, 1, 0, 0.1, None, "opus"), ("2025-07-01", "s2", None, 300, 0, 0, 0.0, None, None), (None, "s3", "opus", 1, 0, 0, 0.0, None, None)]
    u = usage(spark, rows, "date string, session_id string, model string, input_tokens long, output_tokens long, reasoning_tokens long, cost double, credits double, missing_pricing_model string")
    day = {r.date: r for r in report.period_report(u).collect()}
    assert set(day) == {"2025-06-10", "2025-06-12", "2025-07-01"}
    one = day["2025-06-10"]
    assert one.credits == 0.8 and one.total_tokens == 172 and one.models_used == ["opus", "sonnet"] and [m.model for m in one.model_breakdowns] == ["sonnet", "opus"]
    assert day["2025-07-01"].model_breakdowns == [] and day["2025-07-01"].credits is None
    assert {r.date: r.input_tokens for r in report.period_report(u, "monthly").collect()} == {"2025-06": 111, "2025-07": 300}
    assert {r.date: r.input_tokens for r in report.period_report(u, "weekly", "sunday").collect()} == {"2025-06-08": 111, "2025-06-29": 300}
    total = report.grand_totals(report.period_report(u)).first()
    assert total.total_tokens == 467 and total.credits == 0.8
    assert [r.date for r in report.filter_models(report.period_report(u), "SONNET").collect()] == ["2025-06-10"]
    assert [r.model for r in report.missing_models(report.period_report(u)).collect()] == ["opus"]
    assert {r.session_id for r in report.session_report(u).collect()} == {"s1", "s2", "s3"}
    assert [r.date for r in report.sort_report(report.period_report(u), "desc").collect()] == ["2025-07-01", "2025-06-12", "2025-06-10"]
    assert "cost" not in report.without_costs(report.period_report(u)).columns
    assert report.period_report(u.limit(0)).count() == 0
    assert [r.input_tokens for r in report.rollup(u).where("level = 3").collect()] == [412]


def test_sequences(spark):
    df = spark.createDataFrame([("f", 1, 100, "a"), ("f", 2, 130, None), ("f", 3, 90, None), ("g", 1, None, None), ("g", 2, 5, "b")], "f string, i int, total long, m string")
    d = sequence.carry_forward(sequence.cumulative_delta(df, "total", "d", ["f"], ["i"]), "m", "c", ["f"], ["i"], "gpt-5").orderBy("f", "i").collect()
    assert [r.d for r in d] == [100, 30, 0, 0, 5] and [r.c for r in d] == ["a", "a", "a", "gpt-5", "b"]


def test_replays(spark):
    rows = [("f", i, s) for i, s in enumerate(["s1", "s1", None, "s2", "s1"])] + [("g", 0, "s1"), ("g", 1, "s2"), ("h", 0, "s1"), ("h", 1, "s1")]
    df = spark.createDataFrame(rows, "f string, i int, s string")
    got = sequence.replay_flag(df, F.col("s"), F.col("s").isNotNull(), ["f"], ["i"], F.col("f") != "h").orderBy("f", "i").collect()
    assert [r.replayed for r in got] == [True, True, False, False, False, False, False, False, False]


def test_as_of(spark):
    days = ["2025-08-06", "2025-08-07", "2025-12-10", "2026-04-23", "2027-01-01", "x"]
    df = spark.createDataFrame([(d + "T00:00:00Z" if len(d) > 1 else d,) for d in days], "t string")
    got = [r.m for r in df.select(sequence.review_model(F.lit("codex-auto-review"), F.col("t")).alias("m")).collect()]
    assert got == ["gpt-5", "gpt-5", "gpt-5.1-codex", "gpt-5.5", "gpt-5.5", "gpt-5"]


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("", 5), ("", 6), (None, 7)], "id string, o int")
    assert sorted((r.id or "-", r.o) for r in dedup.first_wins(df, "id", ["o"]).collect()) == [("-", 5), ("-", 6), ("-", 7), ("a", 0)]
