"""Reports from the command line: python -m tokentally.cli daily -a claude."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally import render
from tokentally.functions import text
from tokentally.functions.dates import parse_weekday, zone
from tokentally.operators import blocks, report
from tokentally.plans import pricing
from tokentally.session import build_session, scratch
from tokentally.sources import all as sources
from tokentally.sources.files import Options
from tokentally.streaming import live

COMMANDS = ("all", "daily", "weekly", "monthly", "session", "blocks", "statusline", "daemon", "update-price")


def parser(defaults: dict | None = None) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokentally", description=__doc__)
    p.add_argument("command", nargs="?", default="all", choices=COMMANDS)
    p.add_argument("-a", "--agent", default="claude")
    p.add_argument("-m", "--model")
    p.add_argument("-p", "--project")
    p.add_argument("-s", "--since")
    p.add_argument("-u", "--until")
    p.add_argument("--timezone", default="UTC", help="a zone, or `log`: generic agents' records are dated by their own offset, others in UTC")
    p.add_argument("--order", default="asc", type=lambda s: "desc" if s.lower() == "desc" else "asc")
    p.add_argument("--start-of-week", default="monday", type=parse_weekday)
    p.add_argument("--kind", default="daily", choices=("daily", "weekly", "monthly"), help="period of `all`")
    p.add_argument("--project-aliases", default="")
    p.add_argument("--json", action="store_true")
    p.add_argument("--jq", metavar="PATH", help="part of the JSON, such as .totals.cost")
    p.add_argument("--no-cost", action="store_true")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--breakdown", action="store_true")
    p.add_argument("--color", default="auto", choices=("auto", "always", "never"))
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--token-limit", default="500000")
    p.add_argument("--session-length", type=float, default=5.0, help="hours")
    p.add_argument("--active", action="store_true")
    p.add_argument("--interval", type=int, default=30, help="seconds between the daemon's looks")
    p.add_argument("--once", action="store_true", help="one look of the daemon")
    p.add_argument("--checkpoint", metavar="FOLDER", help="where the daemon keeps how far it has read, so that it goes on from there")
    p.add_argument("--config", help="a JSON file with `pricing`, `defaults` and `commands`")
    p.add_argument("--merge", help="update-price: a JSON file whose `pricing` replaces the config's")
    p.add_argument("--match-dated-models", action="store_true")
    p.add_argument("--fast-multiplier", default="always", choices=("always", "when_fast"))
    p.add_argument("-v", "--verbose", action="store_true", help="tell on standard error what is read and how long it takes")
    p.add_argument("--log-json", action="store_true", help="the same as JSON lines")
    p.add_argument("--single-thread", action="store_true", help="one local core")
    p.add_argument("--offline", action="store_true", help="accepted for compatibility: there is no network access anyway")
    p.add_argument("--output", metavar="FOLDER", help="write the report's rows as JSON lines to a folder, without taking them to the driver")
    p.set_defaults(**{k.replace("-", "_"): v for k, v in (defaults or {}).items()})
    return p


def options(argv: list[str]) -> argparse.Namespace:
    """Flags over the config's settings for the command over its defaults; settings at the config's top level count as defaults."""
    first = parser().parse_args(argv)
    if not first.config:
        return first
    config = json.loads(Path(first.config).read_text())
    for warning in config_warnings(config):
        print(f"{first.config}: {warning}", file=sys.stderr)
    known = vars(first)
    own = {k: v for k, v in config.items() if k.replace("-", "_") in known}
    return parser({**own, **config.get("defaults", {}), **config.get("commands", {}).get(first.command, {})}).parse_args(argv)


def config_warnings(config) -> list[str]:
    """What in a config isn't used, or of the wrong kind; none of it stops a command."""
    if not isinstance(config, dict):
        return ["not an object"]
    flags, out = set(vars(parser().parse_args([]))) - {"command"}, []
    sections = {"defaults": config.get("defaults", {}), **{f"commands.{k}": v for k, v in (config.get("commands") or {}).items()}} if isinstance(config.get("commands", {}), dict) else {"defaults": config.get("defaults", {})}
    for key, value in config.items():
        if key in ("defaults", "commands", "pricing"):
            if not isinstance(value, dict):
                out.append(f"{key} is not an object")
        elif key.replace("-", "_") not in flags and key != "$schema":
            out.append(f"unknown setting {key}")
    for name, section in sections.items():
        if name.startswith("commands.") and name[9:] not in COMMANDS:
            out.append(f"unknown command {name[9:]}")
        if not isinstance(section, dict):
            out.append(f"{name} is not an object")
            continue
        out += [f"unknown setting {name}.{k}" for k in section if k.replace("-", "_") not in flags]
    if isinstance(config.get("pricing"), dict):
        for model, price in config["pricing"].items():
            if not isinstance(price, dict):
                out.append(f"the price of {model} is not an object")
                continue
            out += [f"the price of {model} has no {k}" for k in ("input", "output") if k not in price]
            out += [f"{k} of {model} is not a number of 0 or more" for k, v in price.items() if isinstance(v, bool) or not isinstance(v, int | float) or v < 0]
    return out


class Log:
    """Progress on standard error, as text or JSON lines, if asked for."""

    def __init__(self, o: argparse.Namespace):
        self.on, self.json, self.began = o.verbose or o.log_json, o.log_json, time.time()

    def __call__(self, what: str, **facts) -> None:
        if self.on:
            facts = {"seconds": round(time.time() - self.began, 3), **facts}
            print(json.dumps({"level": "info", "message": what, **facts}) if self.json else f"{what} {' '.join(f'{k}={v}' for k, v in facts.items())}", file=sys.stderr, flush=True)


def load_options(spark: SparkSession, o: argparse.Namespace) -> Options:
    return Options(pricing.default_prices(spark, o.config), "log" if o.timezone == "log" else zone(o.timezone), o.since, o.until, o.project, o.match_dated_models, o.fast_multiplier)


def load(spark: SparkSession, o: argparse.Namespace, agents: list[str]) -> DataFrame:
    opt = load_options(spark, o)
    usage = report.union_all([sources.get(a).read(spark, opt) for a in agents])
    aliases = text.parse_aliases(o.project_aliases)
    return usage.withColumn("project", text.project_name(F.col("project"), aliases)) if aliases else usage


def available() -> list[str]:
    return [n for n in sources.names() if sources.get(n).available()]


def run(argv: list[str], spark: SparkSession | None = None) -> str:
    """A command's output."""
    o = options(argv)
    if o.command == "update-price":
        return update_prices(o.config, o.merge)
    log = Log(o)
    spark = spark or build_session(**({"spark.master": "local[1]"} if o.single_thread else {}))
    agents = (available() or ["claude"]) if o.command == "all" or o.agent == "all" else [o.agent]
    log("read", agents=",".join(agents), command=o.command)
    if agents == ["codex"] and o.command in ("daily", "weekly", "monthly", "session"):
        out = codex_period(spark, o)
        log("done")
        return out
    usage = load(spark, o, agents)
    color = o.color == "always" and not o.no_color
    if o.command in ("blocks", "statusline"):
        seconds, limit = int(o.session_length * 3600), text.token_limit(o.token_limit)
        found = blocks.activity_blocks(usage, session_seconds=seconds)
        if o.command == "statusline":
            return render.statusline(found, F.current_timestamp())
        if o.json or o.jq:
            return render.dump(render.pick(json.loads(render.blocks_json(found, blocks.gap_rows(found, session_seconds=seconds), limit, o.active)), o.jq))
        return render.blocks_table(found.where("is_active") if o.active else found, limit, seconds)
    if o.command == "daemon":
        return watch(spark, o, agents, log)
    if o.command == "session":
        key, rows = "session_id", report.session_report(usage)
    elif o.command == "all":
        key, rows = "date", report.period_report(usage, o.kind, o.start_of_week, ("agent",))
    else:
        key, rows = "date", report.period_report(usage, o.command, o.start_of_week)
    if o.model:
        rows = report.filter_models(rows, o.model)
    if o.output:
        rows.write.mode("errorifexists").json(o.output)
        log("written", folder=o.output)
        return f"Rows written to {o.output}"
    rows = report.sort_report(rows, o.order, key).cache()
    totals = report.grand_totals(rows)
    kind = o.command if o.command != "all" else "daily"
    out = render.report_json(kind, rows, totals, o.no_cost, o.jq) if o.json or o.jq else render.title(f"Token usage: {o.command} ({', '.join(map(text.agent_name, agents))})", color) + render.report_table(rows, totals, key, o.compact, o.breakdown, color)
    rows.unpersist()
    log("done")
    return out


def codex_period(spark: SparkSession, o: argparse.Namespace) -> str:
    """Codex's own report: a row for each period or session with a map of its models' usage."""
    from tokentally.sources.codex import CodexSource, codex_report

    source = CodexSource()
    rows = codex_report(source.events(spark), pricing.default_prices(spark, o.config), "session" if o.command == "session" else o.command, zone(o.timezone), source.fast(), o.start_of_week, o.since, o.until)
    if o.model:
        rows = rows.where(F.exists(F.map_keys("models"), lambda m: F.contains(F.lower(m), F.lit(o.model.lower()))))
    rows = rows.orderBy(F.col("period").desc() if o.order == "desc" else F.col("period").asc())
    if o.output:
        rows.write.mode("errorifexists").json(o.output)
        return f"Rows written to {o.output}"
    if o.json or o.jq:
        return render.codex_json(o.command, rows, o.no_cost, o.jq)
    return render.title(f"Token usage: {o.command} ({text.agent_name('codex')})", o.color == "always" and not o.no_color) + render.codex_table(rows, "Session" if o.command == "session" else "Date", o.compact)


def watch(spark: SparkSession, o: argparse.Namespace, agents: list[str], log: Log) -> str:
    """The snapshot of all that is there; again after each interval unless ``--once``.

    Where an agent's records can be streamed, its logs are followed: what is added to them is read once, and
    totals go on from there, also after a restart with the same ``--checkpoint``.  Other agents' logs are read again, each agent's
    only if one of its files came, went or changed since.  Looks never overlap.
    An interrupt or a termination signal ends the loop after the look at hand.
    """
    if o.once:
        return snapshot_text(report.snapshot(load(spark, o, agents)), o)
    stop = threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    followed = [a for a in agents if hasattr(sources.get(a), "records")]
    checkpoint = o.checkpoint or f"{scratch(spark)}/daemon-{uuid.uuid4().hex}"
    query = None
    if followed:
        opt = load_options(spark, o)
        stream = report.union_all([sources.get(a).records(spark, opt) for a in followed])
        query = live.watch_records(stream, lambda totals, n: log("followed", batch=n), checkpoint, f"{max(1, o.interval)} seconds")
        query.processAllAvailable()
    seen, read = {}, {}
    try:
        while True:
            for a in agents:
                now = fingerprint([a]) if a not in followed else None
                if now is not None and now != seen.get(a):
                    # A row for each agent, project and model: as many as are shown.
                    rows = load(spark, o, [a]).withColumn("change", F.lit(1)).groupBy("agent", "project", "model").agg(*[F.sum(c).alias(c) for c in live.TOTALS if c != "records"], F.count("*").alias("records"))
                    read[a], seen[a] = spark.createDataFrame(rows.collect(), rows.schema), now
                    log("looked", agent=a, files=len(now))
            totals = [t for t in (live.last_totals(spark, checkpoint) if followed else None, *read.values()) if t is not None]
            print(snapshot_text(live.totals_snapshot(report.union_all(totals)), o) if totals else "No usage yet", flush=True)
            if pause(stop, max(1, o.interval)):
                return ""
            if query is not None and query.exception() is not None:
                raise query.exception()
    finally:
        if query is not None:
            query.stop()


def pause(stop: threading.Event, seconds: float) -> bool:
    """Wait; true if it is time to stop."""
    return stop.wait(seconds)


def snapshot_text(found: DataFrame, o: argparse.Namespace) -> str:
    s = render.report_rows(found)[0]
    return render.dump(s) if o.json else f"{s['records']} records, {s['in_out_tokens'] or 0:,} tokens, ${s['cost'] or 0:.2f}, {len(s['models'])} models, {len(s['projects'])} projects"


def fingerprint(agents: list[str]) -> frozenset[tuple[str, int, int]]:
    """Each log file's name, size and time of change; the folders are this machine's own."""
    found = set()
    for a in agents:
        try:
            folders = sources.get(a).paths()
        except FileNotFoundError:
            folders = []
        for folder in folders:
            for top, _, names in os.walk(folder):
                for n in names:
                    path = os.path.join(top, n)
                    try:
                        st = os.stat(path)
                    except OSError:
                        continue
                    found.add((path, st.st_size, st.st_mtime_ns))
    return frozenset(found)


def update_prices(config: str, merge: str) -> str:
    """Replace the config's ``pricing`` by the other file's and tell what changed."""
    old, new = json.loads(Path(config).read_text()), json.loads(Path(merge).read_text())["pricing"]
    before = old.get("pricing", {})
    changes = {"added": sorted(set(new) - set(before)), "removed": sorted(set(before) - set(new)), "updated": sorted(m for m in set(new) & set(before) if new[m] != before[m])}
    Path(config).write_text(json.dumps({**old, "pricing": new}, indent=2) + "\n")
    return render.dump(changes)


if __name__ == "__main__":
    print(run(sys.argv[1:]))
