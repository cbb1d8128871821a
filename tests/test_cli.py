from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tokentally import cli, render
from tokentally.operators import blocks
from tokentally.schema import canonical


@pytest.fixture
def home(tmp_path, monkeypatch):
    def put(project, session, rows):
        f = tmp_path / "cfg" / "projects" / project / f"{session}.jsonl"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("\n".join(json.dumps({"timestamp": t, "requestId": f"r{i}{session}", "message": {"id": f"m{i}{session}", "model": m, "usage": {"input_tokens": n, "output_tokens": 10}}}, separators=(",", ":")) for i, (t, m, n) in enumerate(rows)))

    put("p1", "a", [("2025-01-10T10:00:00Z", "claude-sonnet-4-6", 1000), ("2025-01-10T11:00:00Z", "claude-haiku-4-5", 500), ("2025-02-01T00:00:00Z", "claude-sonnet-4-6", 1)])
    put("p2", "b", [("2025-01-10T10:30:00Z", "mystery", 7)])
    monkeypatch.setenv("CLAUDE_CONFIG_DIR", str(tmp_path / "cfg"))
    monkeypatch.setenv("HOME", str(tmp_path))
    return tmp_path


def test_json_reports(spark, home):
    doc = json.loads(cli.run(["daily", "--json"], spark))
    assert [(r["date"], r["input_tokens"]) for r in doc["daily"]] == [("2025-01-10", 1507), ("2025-02-01", 1)]
    assert doc["totals"]["input_tokens"] == 1508 and doc["totals"]["cost"] == pytest.approx(0.003 + 0.0005 + 3e-6 + 1e-5 * 30 + 1e-5 * 5)
    assert json.loads(cli.run(["monthly", "--jq", ".monthly[].date", "--order", "desc"], spark)) == ["2025-02", "2025-01"]
    assert json.loads(cli.run(["session", "--json", "-p", "p2"], spark))["sessions"][0]["session_id"] == "b"
    assert json.loads(cli.run(["daily", "--jq", ".daily[].date", "-m", "HAIKU"], spark)) == ["2025-01-10"]
    assert json.loads(cli.run(["daily", "--jq", ".totals.input_tokens", "-s", "2025-01-11"], spark)) == 1
    assert "cost" not in cli.run(["daily", "--json", "--no-cost"], spark)
    assert json.loads(cli.run(["--json", "--jq", ".daily[].agent"], spark)) == ["claude", "claude"]


def test_tables(spark, home):
    out = cli.run(["daily", "--breakdown", "--no-color"], spark)
    assert "2025-01-10" in out and "└ claude-haiku-4-5" in out and "No price for model mystery" in out and "Total" in out
    assert "Gap" in cli.run(["blocks"], spark) and "Active" in cli.run(["blocks", "--active"], spark)
    doc = json.loads(cli.run(["blocks", "--json", "--token-limit", "5K"], spark))
    assert doc["tokenLimit"] == 5000 and len(doc["blocks"]) == 2 and len(doc["gaps"]) == 1
    assert cli.run(["statusline"], spark).startswith("⚡ claude-sonnet-4-6 │ $0.00 │ 11 │ ")
    assert cli.run(["daemon", "--once"], spark).startswith("4 records, 1,548 tokens")


def test_codex_report(spark, tmp_path, monkeypatch):
    f = tmp_path / "sessions" / "a.jsonl"
    f.parent.mkdir()
    line = lambda t, n: {"timestamp": t, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 10, "total_tokens": n + 10}}}}
    f.write_text("\n".join(json.dumps(r, separators=(",", ":")) for r in ({"timestamp": "2025-10-01T09:00:00Z", "type": "turn_context", "payload": {"model": "gpt-5"}}, line("2025-10-01T10:00:00Z", 1000), line("2025-10-08T10:00:00Z", 3000))))
    monkeypatch.setenv("CODEX_HOME", str(tmp_path))
    doc = json.loads(cli.run(["daily", "-a", "codex", "--json"], spark))
    assert [(r["period"], r["input_tokens"]) for r in doc["daily"]] == [("2025-10-01", 1000), ("2025-10-08", 2000)] and set(doc["daily"][0]["models"]) == {"gpt-5"}
    assert doc["totals"]["total_tokens"] == 3010 and doc["totals"]["cost"] == pytest.approx(3000 * 1.25e-6 + 10 * 1e-5)
    assert json.loads(cli.run(["session", "-a", "codex", "--jq", ".sessions | length"], spark)) == 1
    out = cli.run(["weekly", "-a", "codex", "--no-color", "-s", "2025-10-07"], spark)
    assert "2025-10-06" in out and "2025-09-29" not in out and "- gpt-5" in out and "Total" in out
    (tmp_path / "config.toml").write_text('service_tier = "fast"\n')
    fast = json.loads(cli.run(["daily", "-a", "codex", "--jq", ".totals.cost"], spark))
    assert fast == pytest.approx(2 * doc["totals"]["cost"])
    assert cli.run(["monthly", "-a", "codex", "-m", "none"], spark).endswith("No Codex usage found.")


def test_output_flags_and_watch(spark, home, capsys, tmp_path):
    assert "written to" in cli.run(["session", "--output", str(tmp_path / "rows")], spark)
    assert sorted(r.session_id for r in spark.read.json(str(tmp_path / "rows")).collect()) == ["a", "b"]
    cli.run(["daily", "-v", "--offline", "--single-thread"], spark)
    assert "read" in capsys.readouterr().err
    cli.run(["daily", "--log-json"], spark)
    assert json.loads(capsys.readouterr().err.splitlines()[0])["message"] == "read"


def test_daemon_follows_logs(spark, home, capsys, monkeypatch):
    """Claude's and Amp's logs are followed while they grow; OpenCode's are read again only when they changed; a restart goes on from the checkpoint."""
    log = home / "cfg" / "projects" / "p1" / "a.jsonl"
    log.write_text(log.read_text() + "\n")
    (home / ".amp").mkdir()
    amp = lambda n: json.dumps({"timestamp": "2025-01-10T10:00:00Z", "message": {"model": "gpt-5", "usage": {"input_tokens": n, "output_tokens": 1}}}, separators=(",", ":")) + "\n"
    (home / ".amp" / "x.jsonl").write_text(amp(100))
    store = home / ".local" / "share" / "opencode" / "storage" / "message"
    store.mkdir(parents=True)
    message = lambda n: json.dumps({"id": f"o{n}", "providerID": "p", "modelID": "k", "time": {"created": 1736503200000}, "tokens": {"input": n, "output": 0}})
    (store / "1.json").write_text(message(1000))
    o, looks, plain, rounds = cli.options(["daemon", "--interval", "1", "--checkpoint", f"file://{home}/ck"]), [], cli.load, []
    monkeypatch.setattr(cli, "load", lambda s, o, agents: looks.append(agents) or plain(s, o, agents))

    def pause(stop, seconds):
        rounds.append(capsys.readouterr().out.strip())
        if len(rounds) == 1:
            again = log.read_text().splitlines()[0]  # the same message with more tokens takes the first one's place
            with log.open("a") as f:
                f.write(again.replace('"input_tokens":1000', '"input_tokens":1500') + "\n")
            with (home / ".amp" / "x.jsonl").open("a") as f:
                f.write(amp(20))
            next(q for q in spark.streams.active).processAllAvailable()
        if len(rounds) == 2:
            (store / "2.json").write_text(message(5))
        return len(rounds) >= 3

    monkeypatch.setattr(cli, "pause", pause)
    cli.watch(spark, o, ["amp", "claude", "opencode"], cli.Log(o))
    head = [r.split(" tokens")[0] for r in rounds]
    # p2's only line has no newline yet.
    assert head == ["5 records, 2,632", "6 records, 3,153", "7 records, 3,158"] and looks == [["opencode"], ["opencode"]] and not spark.streams.active
    rounds.clear()
    with (home / ".amp" / "x.jsonl").open("a") as f:
        f.write(amp(3))
    monkeypatch.setattr(cli, "pause", lambda stop, s: rounds.append(capsys.readouterr().out.strip()) or True)
    cli.watch(spark, o, ["amp", "claude"], cli.Log(o))
    assert rounds[0].startswith("6 records, 2,157 tokens") and len(looks) == 2


def test_config_warnings():
    assert cli.config_warnings([]) == ["not an object"]
    assert cli.config_warnings({"order": "desc", "defaults": {"timezone": "UTC"}, "commands": {"daily": {"compact": True}}, "pricing": {"a": {"input": 1, "output": 2}}}) == []
    assert cli.config_warnings({"x": 1, "defaults": {"y": 1}, "commands": {"nope": {}}, "pricing": {"a": {"input": -1}, "b": 3}}) == ["unknown setting x", "unknown setting defaults.y", "unknown command nope", "the price of a has no output", "input of a is not a number of 0 or more", "the price of b is not an object"]


def test_options(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"order": "desc", "defaults": {"timezone": "Asia/Tokyo"}, "commands": {"daily": {"compact": True}}, "pricing": {"a": {"input": 1, "output": 1}}}))
    o = cli.options(["daily", "--config", str(tmp_path / "c.json")])
    assert (o.order, o.timezone, o.compact) == ("desc", "Asia/Tokyo", True)
    assert cli.options(["daily", "--config", str(tmp_path / "c.json"), "--timezone", "UTC"]).timezone == "UTC"
    (tmp_path / "n.json").write_text(json.dumps({"pricing": {"a": {"input": 2, "output": 1}, "b": {"input": 1, "output": 1}}}))
    assert json.loads(cli.run(["update-price", "--config", str(tmp_path / "c.json"), "--merge", str(tmp_path / "n.json")])) == {"added": ["b"], "removed": [], "updated": ["a"]}
    assert json.loads((tmp_path / "c.json").read_text())["order"] == "desc"


def test_rendering():
    assert render.table(["A", "B"], [["x\ny", "1"], None, ["é", "22"]], [False, True]).split("\n") == ["A   B", "─────", "x   1", "y", "─────", "é  22"]
    assert render.width("\x1b[31mab\x1b[0m日") == 4 and render.truncate("abcdef", 4) == "abc…"
    assert render.pick({"a": [{"b": 1}, {"b": 2}]}, ".a[].b") == [1, 2] and render.pick({"a": [5]}, ".a[0]") == 5
    doc = {"a": [{"b": 1}, {"b": 2}]}
    assert [render.pick(doc, p) for p in (".a | length", ".a | map(.b) | add", ". | keys", ".a | map(.b)", ".a | .[0] | .b")] == [2, 3, ["a"], [1, 2], 1]
    with pytest.raises(ValueError, match="not a path"):
        render.pick({}, "a | b")
    assert render.strip_costs({"cost": 1, "x": [{"costUSD": 2, "y": 3}]}) == {"x": [{"y": 3}]}


def test_statusline_without_data(spark):
    none = canonical(spark.range(0))
    assert render.statusline(blocks.activity_blocks(none), F.current_timestamp()) == "no data" and render.blocks_table(blocks.activity_blocks(none), 1) == "No blocks found."
