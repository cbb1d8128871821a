from __future__ import annotations

import datetime
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tokentally.plans.pricing import built_in
from tokentally.sources import claude, codex, generic, opencode
from tokentally.sources.all import get, get_all, names
from tokentally.sources.files import Options, lines


def write(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes((end.join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows)).encode())


def line(t="2025-01-10T10:00:00.000Z", mid="m1", rid="r1", model="claude-sonnet-4-6", out=25, **more):
    usage = {"input_tokens": 100, "output_tokens": out, **more.pop("usage", {})}
    return {"timestamp": t, "sessionId": "s", "requestId": rid, "version": "1.2.3", "message": {"id": mid, "model": model, "usage": usage}, **more}


def test_registry():
    assert names() == ["amp", "claude", "codebuff", "codex", "copilot", "droid", "gemini", "goose", "hermes", "kilo", "kimi", "openclaw", "opencode", "pi", "qwen"]
    assert [s.name for s in get_all()] == names()
    with pytest.raises(KeyError):
        get("nobody")


def test_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.jsonl").write_bytes(b"one\r\n\ntwo\rstill two\nlast")
    (tmp_path / "d" / "x.txt").write_bytes(b"other")
    got = lines(spark, [str(tmp_path)]).orderBy("row_id").collect()
    assert [r.value for r in got] == ["one", "two\rstill two", "last"] and got[0].file_path.endswith("/d/a b.jsonl")
    assert lines(spark, []).count() == 0


def test_claude(spark, tmp_path):
    root = tmp_path / "projects"
    write(root / "p1" / "s1.jsonl", [
        line(out=25), line(out=250, usage={"speed": "fast"}),  # the same message, then complete
        line(mid="m2", rid="r2", t="2025-02-15T10:00:00Z", usage={"cache_creation_input_tokens": 100, "cache_creation": {"ephemeral_5m_input_tokens": 50, "ephemeral_1h_input_tokens": 30}}),
        line(mid="m3", rid="r3", model="<synthetic>", t="2025-03-20T10:00:00"),
        line(mid="", rid="x"), line(mid="m9", version="v1"), line(mid="m8", t="yesterday"), "not json", '{"usage": {"a":1}}',
        json.dumps(line(mid="m7"), separators=(",", ":")).replace('"sessionId":"s"', '"sessionId":null'),
        json.dumps(line(mid="m6"), separators=(",", ":")).replace('"output_tokens":25', '"output_tokens":"25"'),
        json.dumps(line(mid="m5"), separators=(",", ":")).replace('"output_tokens":25', '"output_tokens":-5'),
    ], "\r\n")
    write(root / "p1" / "s1" / "subagents" / "x.jsonl", [line(mid="m4", rid="r4", isSidechain=True)])
    write(root / "p2" / "deep" / "er" / "s3.jsonl", [line(out=10), line(mid="m10", rid="r10")])
    src, opt = claude.ClaudeSource(), Options(built_in(spark))
    got = {r.message_id: r for r in src.read(spark, opt, [str(root)]).collect()}
    assert set(got) == {"m1", "m2", "m3", "m4", "m10"}
    assert got["m1"].output_tokens == 250 and got["m1"].model == "claude-sonnet-4-6-fast" and got["m1"].price_model == "claude-sonnet-4-6" and got["m1"].cost == pytest.approx(100 * 3e-6 + 250 * 15e-6)
    assert got["m2"].cache_creation_tokens == 80
    assert got["m3"].model is None and got["m3"].missing_pricing_model == "<synthetic>"
    assert [(got[m].session_id, got[m].project, got[m].project_path) for m in ("m1", "m4", "m10")] == [("s1", "p1", "p1"), ("s1", "p1", "p1"), ("er", "p2", "p2/deep")]
    one = lambda **kw: {r.message_id for r in src.read(spark, Options(built_in(spark), **kw), [str(root)]).collect()}
    assert one(since="20250201") == {"m2", "m3"} and one(until="2025-02-01") == {"m1", "m4", "m10"} and one(project="p2") == {"m1", "m10"}


def test_a_strict_parse_holds_for_any_column(spark, tmp_path):
    write(tmp_path / "projects" / "p" / "s.jsonl", [json.dumps(line(), separators=(",", ":")).replace('"output_tokens":25', '"output_tokens":"x"'), line(mid="ok", rid="r")])
    raw = lines(spark, [str(tmp_path)])
    assert [r.message_id for r in claude.parse_claude(raw).select("message_id").collect()] == ["ok"]
    assert claude.parse_claude(raw).select("agent").count() == 1


def test_claude_roots(tmp_path, monkeypatch):
    (tmp_path / "a" / "projects" / "p").mkdir(parents=True)
    monkeypatch.setenv("CLAUDE_CONFIG_DIR", f"{tmp_path}/a, {tmp_path}/a/projects,{tmp_path}/none")
    assert claude.ClaudeSource().paths() == [str(tmp_path / "a" / "projects")]
    assert claude.ClaudeSource().paths("p") == [str(tmp_path / "a" / "projects" / "p")] and not claude.ClaudeSource().available()
    monkeypatch.setenv("CLAUDE_CONFIG_DIR", str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        claude.roots()
    monkeypatch.delenv("CLAUDE_CONFIG_DIR")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    (tmp_path / "claude" / "projects").mkdir(parents=True)
    assert str(tmp_path / "claude" / "projects") in claude.ClaudeSource().paths()


def generic_line(**kw):
    u = {"input_tokens": 100, "output_tokens": 50, **kw.pop("usage", {})}
    return {"timestamp": "2025-01-10T23:30:00-05:00", "sessionId": "s", "message": {"model": "gpt-5", "usage": u}, **kw}


def test_generic(spark, tmp_path):
    none = generic_line()
    none["message"].pop("usage")
    write(tmp_path / "a.jsonl", [generic_line(), generic_line(costUSD=0.05), {k: v for k, v in generic_line().items() if k != "sessionId"}, none, generic_line(usage={"input_tokens": 0, "output_tokens": 0}), "{}", generic_line(usage={"input_tokens": -1}), {**generic_line(), "timestamp": "2025-01-10T10:00:00"}, {**generic_line(), "message": {"model": "who", "usage": {"input_tokens": 1}}}, "bad"])
    got = generic.GenericSource("amp", ()).read(spark, Options(built_in(spark)), [str(tmp_path)]).orderBy("row_id").collect()
    assert [(r.session_id, r.date, r.model, r.missing_pricing_model) for r in got] == [("s", "2025-01-11", "gpt-5", None)] * 2 + [("unknown", "2025-01-11", "gpt-5", None), ("s", "2025-01-11", "who", "who")]
    assert [r.cost for r in got] == [pytest.approx(100 * 1.25e-6 + 50 * 1e-5), 0.05, pytest.approx(100 * 1.25e-6 + 50 * 1e-5), 0.0]


def total(ts, n, model=None, last=None, kind="token_count"):
    info = {"total_token_usage": {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": 10, "total_tokens": n + 10}}
    if last is not None:
        info["last_token_usage"] = {"input_tokens": last, "output_tokens": 1, "total_tokens": last + 1}
    if model:
        info["model"] = model
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": kind, "info": info}}


def context(model):
    return {"timestamp": "2025-10-01T09:00:00Z", "type": "turn_context", "payload": {"model": model}}


def test_codex(spark, tmp_path):
    t = "2025-10-01T10:00:0{}Z".format
    write(tmp_path / "sessions" / "2025" / "a.jsonl", [total(t(1), 100), total(t(2), 130), total(t(3), 90), context("gpt-5.1-codex"), total(t(4), 200, last=7), total(t(5), 260), context("codex-auto-review"), total(t(6), 300)])
    write(tmp_path / "sessions" / "sub.jsonl", ["thread_spawn", total(t(1), 500), total(t(1), 600), total(t(2), 650), total(t(1), 660)])
    write(tmp_path / "sessions" / "h.jsonl", [
        {"created_at": 1759312800, "model": " gpt-x ", "usage": {"prompt_tokens": 10, "completion_tokens": 5, "cached_tokens": 20}},
        {"timestamp": "2025-10-01T10:00:00Z", "data": {"model_name": "gpt-y", "usage": {"input": 3, "output": 4}}}, {"usage": {"input_tokens": 0}}, {"usage": {"input_tokens": 1}},
    ])
    write(tmp_path / "archived_sessions" / "2025" / "a.jsonl", [total(t(1), 9999)])
    home = str(tmp_path)
    folders = [(f"{home}/sessions", home, 0), (f"{home}/archived_sessions", home, 1)]
    ev = codex.CodexSource().events(spark, folders).orderBy("session_id", "row_id").collect()
    a = [r for r in ev if r.session_id == "2025/a"]
    assert [r.input_tokens for r in a] == [100, 30, 7, 60, 40] and [r.model for r in a] == ["gpt-5", "gpt-5", "gpt-5.1-codex", "gpt-5.1-codex", "gpt-5-codex"]
    assert [r.is_fallback for r in a] == [True, False, False, False, True]
    assert [r.cached_tokens for r in a] == [50, 15, 0, 30, 20]
    assert [r.input_tokens for r in ev if r.session_id == "sub"] == [50, 10]
    h = [r for r in ev if r.session_id == "h"]
    assert [(r.model, r.input_tokens, r.cached_tokens, r.output_tokens, r.total_tokens) for r in h] == [("gpt-x", 10, 10, 5, 15), ("gpt-y", 3, 0, 4, 7), ("gpt-y", 1, 0, 0, 1)]
    assert h[0].ts_text == "2025-10-01T10:00:00.000Z" and h[2].ts_text > "2025"
    events = codex.CodexSource().events(spark, folders)
    rep = {r.period: r for r in codex.codex_report(events.where("session_id = '2025/a'"), built_in(spark)).collect()}
    assert rep["2025-10-01"].input_tokens == 237 and set(rep["2025-10-01"].models) == {"gpt-5", "gpt-5.1-codex", "gpt-5-codex"}
    u = codex.to_usage(events, built_in(spark)).where("session_id = '2025/a'").orderBy("row_id").first()
    assert (u.input_tokens, u.cache_read_tokens, u.cost) == (50, 50, pytest.approx(50 * 1.25e-6 + 50 * 0.125e-6 + 10 * 1e-5))
    assert {r.period for r in codex.group_events(events, "session").collect()} == {"2025/a", "sub", "h"}


def test_opencode(spark, tmp_path):
    def msg(i, **kw):
        return {"id": i, "sessionID": "s", "providerID": "anthropic", "modelID": "claude-sonnet-4.6", "time": {"created": 1736503200000}, "tokens": {"input": 10.9, "output": 5, "cache": {"read": 1, "write": 2}}, **kw}

    for name, data in {"a": msg("a"), "c": msg("c", cost=0.5), "d": msg("d", tokens={"input": 0, "output": 0, "total": 7}), "e": msg("e", tokens={"input": 0}), "f": {**msg("f"), "time": None}, "g": msg("", modelID="")}.items():
        write(tmp_path / "storage" / "message" / "s" / f"{name}.json", [json.dumps(data, indent=1)])
    with sqlite3.connect(tmp_path / "opencode-dev.db") as c:
        c.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
        c.executemany("INSERT INTO message VALUES (?, ?, ?)", [("a", "dbs", json.dumps(msg("zz", cost=9.0))), ("b", "", json.dumps(msg("b"))), ("x", "s", "junk"), ("y", "s", None)])
    got = {r.message_id: r for r in opencode.OpenCodeSource().read(spark, Options(built_in(spark)), [str(tmp_path)]).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].session_id, got["a"].cost) == ("dbs", 9.0) and got["b"].session_id == "s" and got["c"].cost == 0.5 and got["d"].output_tokens == 7
    assert (got["b"].input_tokens, got["b"].cost) == (10, pytest.approx(10 * 3e-6 + 5 * 15e-6 + 2 * 3.75e-6 + 0.3e-6))
    assert opencode.OpenCodeSource().read(spark, Options(built_in(spark)), []).count() == 0


def test_union(spark, tmp_path):
    from tokentally.operators.report import all_agents

    write(tmp_path / "a.jsonl", [generic_line()])
    frames = [generic.GenericSource(n, ()).read(spark, Options(built_in(spark)), [str(tmp_path)]) for n in ("amp", "qwen")]
    assert sorted((r.date, r.agent, r.input_tokens) for r in all_agents(frames).collect()) == [("2025-01-11", "amp", 100), ("2025-01-11", "qwen", 100)]
    assert frames[0].where(F.col("agent") == "amp").count() == 1


def test_codex_stretches(spark):
    """Files cut into stretches of any length give what whole files give: totals, models, fallbacks and replays go on across the cuts."""
    import random

    from tokentally.sources import codex

    rng, rows = random.Random(12), []
    for f in range(14):
        for i in range(rng.randrange(1, 40)):
            t = f"2025-01-01T00:00:{rng.choice([0, 0, 0, 1]) if i < 6 else i:02d}Z"
            n = rng.randrange(0, 50)
            usage = {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": 1, "total_tokens": n + 1}
            info = {"total_token_usage": usage} if rng.random() < 0.7 else {"last_token_usage": usage, "total_token_usage": usage} if rng.random() < 0.5 else {"last_token_usage": usage, "model": "m2"}
            line = rng.choice([{"timestamp": t, "type": "turn_context", "payload": {"model": f"m{rng.randrange(3)}"}}] + 4 * [{"timestamp": t, "type": "event_msg", "payload": {"type": "token_count", "info": info}}] + [{"timestamp": t, "usage": {"input_tokens": n, "output_tokens": 2}}, {"timestamp": t, "type": 7, "thread_spawn": 1, "payload": 3}])
            rows.append((json.dumps(line, separators=(",", ":")), f"/x/{f}.jsonl", i // 20, datetime.datetime(2025, 1, 1), i))
        if f % 2:
            rows.append(('{"note":"thread_spawn"}', f"/x/{f}.jsonl", 0, datetime.datetime(2025, 1, 1), 99))
    raw = spark.createDataFrame(rows, "value string, file_path string, file_block_start long, file_time timestamp, row_id long").cache()
    want = sorted(map(repr, codex.parse_codex(raw).collect()))
    assert len(want) > 100
    for size in (1, 4):
        assert sorted(map(repr, codex.parse_codex(raw, segment_rows=size).collect())) == want
    plan = codex.parse_codex(raw, segment_rows=4)
    assert plan._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(file_path") >= 1


def test_subagents_say_so_in_their_first_16_kilobytes(spark, tmp_path):
    """Also in files of several splits: a later mention is none."""
    from tokentally.sources.codex import CodexSource
    from tokentally.sources.heads import file_heads

    event = lambda t, n: json.dumps({"timestamp": t, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n}}}}, separators=(",", ":"))
    own = [event("2025-01-01T00:00:00Z", 1), event("2025-01-01T00:00:00Z", 2), event("2025-01-01T00:00:05Z", 4)]
    filler = [json.dumps({"x": "y" * 90})] * 400
    (tmp_path / "early.jsonl").write_text("\n".join(['{"note":"thread_spawn"}', *own, *filler]))
    (tmp_path / "late.jsonl").write_text("\n".join([*own, *filler, '{"note":"thread_spawn"}']))
    (tmp_path / "cut.jsonl").write_text("\n".join([*own, "z" * (16_384 - sum(len(x) + 1 for x in own) - 6), "thread_spawn"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = CodexSource().events(spark, [(str(tmp_path), "s", 0)]).groupBy("session_id").agg(F.sum("input_tokens").alias("n"), F.count("*").alias("k")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.session_id, r.n, r.k) for r in got) == [("cut", 7, 3), ("early", 4, 1), ("late", 7, 3)]
    heads = file_heads(spark, [str(tmp_path)], size=5).collect()
    assert {r.file_path.rsplit("/", 1)[1]: (r.head, r.bytes) for r in heads}["early.jsonl"] == ('{"not', (tmp_path / "early.jsonl").stat().st_size)


def test_sqlite_filters_and_stream(spark, tmp_path):
    """Comparisons are SQLite's, and the rest Spark's; a stream takes up rows as they are added."""
    from tokentally.sources.sqlite import register_sqlite

    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
    rows = [(f"m{i}", f"s{i % 3}" if i % 5 else None, None if i % 7 == 0 else f"é{i:03d}") for i in range(100)]
    db.executemany("INSERT INTO message VALUES (?, ?, ?)", rows)
    db.commit()
    register_sqlite(spark)
    options = {"path": str(tmp_path / "x.db"), "table": "message", "rowsPerPartition": "30"}
    load = lambda push: spark.read.format("tokentally_sqlite").options(**options, pushFilters=push).load()
    t = load("false")
    for where, keep in {
        "session_id = 's1' AND data IS NOT NULL": lambda r: r[1] == "s1" and r[2],
        "id IN ('m3', 'm4', 'none') OR id = 'm7'": lambda r: r[0] in ("m3", "m4", "m7"),
        "data >= 'é050' AND data < 'é060' AND length(id) = 3": lambda r: r[2] and "é050" <= r[2] < "é060",
        "data LIKE 'é01%'": lambda r: r[2] and r[2].startswith("é01"),
    }.items():
        for df in (t, load("true")):
            assert sorted(r.id for r in df.where(where).collect()) == sorted(r[0] for r in rows if keep(r)), where
        assert t.count() == 100 and t.where("id = 'm9' OR length(id) = 1").count() == 1  # another query of the same table
    from pyspark.sql.datasource import EqualTo, IsNotNull, Not

    from tokentally.sources.sqlite import SqliteSource

    reader = SqliteSource({**options, "pushFilters": "true"}).reader(t.schema)
    other = Not(EqualTo(("id",), "x"))
    assert list(reader.pushFilters([EqualTo(("session_id",), "s1"), IsNotNull(("data",)), other])) == [other] and len(reader.conditions) == 2
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == len([r for r in rows if r[1] == "s1" and r[2]])
    got = []

    def drain():
        s = spark.readStream.format("tokentally_sqlite").schema(t.schema).options(**options).load()
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: got.append(sorted(r.id for r in df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination()

    drain()
    drain()
    db.execute("INSERT INTO message VALUES ('new', NULL, NULL)")
    db.commit()
    drain()
    assert got == [sorted(r[0] for r in rows), ["new"]]


def test_store_rewrites_a_day_alone(spark, tmp_path):
    from tokentally.schema import canonical
    from tokentally.sources import store

    rows = lambda *r: canonical(spark.createDataFrame(list(r), "agent string, date string, session_id string, input_tokens long"))
    folder = str(tmp_path / "store")
    store.write_usage(rows(("a", "2025-01-10", "s", 1), ("a", "2025-01-11", "s", 2), ("b", "2025-01-11", "s", 3), ("a", None, "undated", 9)), folder)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    store.write_usage(rows(("a", "2025-01-11", "s", 20), ("a", "2025-01-11", "t", 30)), folder)
    kept = {f for f, t in files.items() if f.exists() and f.stat().st_mtime_ns == t}
    assert {f.parent.parent.name + "/" + f.parent.name for f in files if f not in kept} == {"date=2025-01-11/agent=a"}
    got = store.read_usage(spark, folder)
    assert sorted((r.agent, r.date or "", r.session_id, r.input_tokens) for r in got.collect()) == [("a", "", "undated", 9), ("a", "2025-01-10", "s", 1), ("a", "2025-01-11", "s", 20), ("a", "2025-01-11", "t", 30), ("b", "2025-01-11", "s", 3)]
    some = store.read_usage(spark, folder, "2025-01-11", "20250111").select("agent", "input_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    at = plan.index("PartitionFilters: [")
    assert "date" in plan[at : plan.index("]", at)] and "ReadSchema: struct<input_tokens:bigint>" in plan and some.count() == 3


def test_written_files_hold_a_batch(tmp_path):
    """However long a file is, its writer keeps one batch of its lines; a file is there once it is whole."""
    import tracemalloc

    import pyarrow as pa

    import tokentally.queries  # noqa: F401
    from tokentally.log_queries import _file_writer

    def batches():
        for n in range(300):
            name = "a/x.jsonl" if n < 299 else "b/y.jsonl"
            assert not (tmp_path / "a/x.jsonl").exists() or n == 299
            yield pa.RecordBatch.from_pydict({"file": [name] * 100, "value": [f"{n}-{i}".ljust(1000, ".") for i in range(100)]})

    tracemalloc.start()
    done = list(_file_writer(str(tmp_path))(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and done[0].to_pydict() == {"files": [2]}
    assert [len((tmp_path / f).read_text().splitlines()) for f in ("a/x.jsonl", "b/y.jsonl")] == [29900, 100]
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["x.jsonl", "y.jsonl"]


def test_a_long_file_among_short_ones_is_written_in_order(spark, tmp_path):
    import tokentally.queries  # noqa: F401
    from tokentally.log_queries import _written

    rows = spark.range(20000).selectExpr("CASE WHEN id % 100 = 0 THEN concat('s/', id % 7) ELSE 'l/0' END AS file", "20000 - id AS event_id", "cast(id AS string) AS value")
    _written(rows, str(tmp_path))
    long = [int(v) for v in (tmp_path / "l/0").read_text().split()]
    assert len(long) == 19800 and long == sorted(long, reverse=True)
    assert sum(len((tmp_path / f"s/{k}").read_text().split()) for k in range(7)) == 200


def test_databases_are_written_by_batches(tmp_path):
    """However many rows a database takes, its writer keeps a batch of them; folders may change within a batch."""
    import tracemalloc

    import pyarrow as pa

    import tokentally.queries  # noqa: F401
    from tokentally.log_queries import _database_writer

    def batches():
        for n in range(300):
            folders = [1] * 100 if n < 299 else [1] * 50 + [3] * 50
            yield pa.RecordBatch.from_pydict({"folder": folders, "id": [f"m{n}-{i}" for i in range(100)], "session_id": ["s"] * 100, "data": ["{}".ljust(1000)] * 100})

    tracemalloc.start()
    for _ in _database_writer(str(tmp_path))(batches()):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["opencode.db"] * 2
    count = lambda k: sqlite3.connect(tmp_path / str(k) / "opencode.db").execute("SELECT count(*), count(DISTINCT id) FROM message").fetchone()
    assert count(1) == (29950, 29950) and count(3) == (50, 50)
