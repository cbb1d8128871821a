"""Small reports as text and JSON, on the driver."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.functions import dates, text

_ANSI = re.compile(r"\x1b\[[0-9;]*m")
COLORS = {"blue": "\x1b[34m", "yellow": "\x1b[33m", "green": "\x1b[32m", "red": "\x1b[31m", "dim": "\x1b[2m"}


def paint(s: str, color: str, on: bool) -> str:
    return f"{COLORS[color]}{s}\x1b[0m" if on else s


def width(s: str) -> int:
    """Columns on a terminal: without colour codes, wide characters count twice."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in _ANSI.sub("", s))


def pad(s: str, n: int, right: bool = False) -> str:
    gap = " " * max(0, n - width(s))
    return gap + s if right else s + gap


def truncate(s: str, n: int) -> str:
    return s if width(s) <= n else _ANSI.sub("", s)[: max(0, n - 1)] + "…"


def table(headers: Sequence[str], rows: Sequence[Sequence[str] | None], right: Sequence[bool], cap: int | None = None) -> str:
    """Aligned columns; cells may have several lines; None is a separator; with a cap, cells are cut."""
    cells = [[([truncate(x, cap) for x in str(c).split("\n")] if cap else str(c).split("\n")) for c in r] if r is not None else None for r in [headers, *rows]]
    sizes = [max([width(x) for r in cells if r for x in r[k]], default=0) for k in range(len(headers))]
    rule = "─" * (sum(sizes) + 2 * (len(sizes) - 1))
    out = []
    for i, r in enumerate(cells):
        if r is None:
            out.append(rule)
            continue
        for line in range(max(len(c) for c in r)):
            out.append("  ".join(pad(c[line] if line < len(c) else "", n, a) for c, n, a in zip(r, sizes, right, strict=True)).rstrip())
        if i == 0:
            out.append(rule)
    return "\n".join(out)


def title(name: str, on: bool = False) -> str:
    bar = paint("═" * 60, "blue", on)
    return f"\n{bar}\n  {paint(name, 'yellow', on)}\n{bar}\n"


def _plain(v):
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, float):
        return 0.0 if not math.isfinite(v) else math.copysign(math.floor(abs(v) * 1e9) / 1e9, v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def report_rows(rows: DataFrame) -> list[dict]:
    """A report's rows; a report has a row for each period or session and is shown whole."""
    return [_plain(r) for r in rows.collect()]


def report_json(kind: str, rows: DataFrame, totals: DataFrame, no_cost: bool = False, path: str | None = None) -> str:
    """{<kind>: rows, totals}; ``path`` (like ``.totals.cost``) picks a part."""
    doc = {"sessions" if kind == "session" else kind: report_rows(rows), "totals": report_rows(totals)[0]}
    return dump(pick(strip_costs(doc) if no_cost else doc, path))


def json_lines(rows: DataFrame, no_cost: bool = False) -> DataFrame:
    """A report's rows as JSON lines (value), with numbers cut as in report_json(); nothing comes to the driver."""

    def plain(c: Column, t: T.DataType, depth: int = 8) -> Column:
        if isinstance(t, T.DoubleType):
            return F.when(c.isNotNull(), text.truncate_9(c))
        if isinstance(t, T.StructType) and depth:
            kept = [f for f in t.fields if not (no_cost and "cost" in f.name.lower())]
            return F.when(c.isNotNull(), F.struct(*[plain(c[f.name], f.dataType, depth - 1).alias(f.name) for f in kept]))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and depth:
            return F.transform(c, lambda x: plain(x, t.elementType, depth - 1))
        return c

    own = [f for f in rows.schema.fields if not (no_cost and "cost" in f.name.lower())]
    return rows.select(F.to_json(F.struct(*[plain(F.col(f.name), f.dataType).alias(f.name) for f in own]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def codex_json(kind: str, rows: DataFrame, no_cost: bool = False, path: str | None = None) -> str:
    """{<kind>: rows with a map of models, totals} of Codex's own report."""
    shown = report_rows(rows)
    sums = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "cost")
    doc = {"sessions" if kind == "session" else kind: shown, "totals": {c: sum(r[c] or 0 for r in shown) for c in sums} if shown else None}
    return dump(pick(strip_costs(doc) if no_cost else doc, path))


def codex_table(rows: DataFrame, head: str = "Date", compact: bool = False) -> str:
    """Period, models (a fallback is marked), token columns and cost; then totals."""
    names = F.transform(F.map_entries("models"), lambda e: F.concat(F.lit("- "), e["key"], F.when(e["value"]["is_fallback"], " (fallback)").otherwise("")))
    counts = ["input_tokens", "output_tokens"] + ([] if compact else ["reasoning_tokens", "cached_tokens"]) + ["total_tokens"]
    shown = rows.select("period", F.array_join(names, "\n").alias("names"), *[text.human_number(F.col(c)).alias(c) for c in counts], text.currency(F.col("cost")).alias("shown_cost"), *[F.col(c).alias(f"n_{c}") for c in counts], "cost").collect()
    if not shown:
        return "No Codex usage found."
    sums = rows.agg(*[text.human_number(F.sum(c)).alias(c) for c in counts], text.currency(F.sum("cost")).alias("cost")).first()
    body: list[list[str] | None] = [[r.period, r.names, *[r[c] for c in counts], r.shown_cost] for r in shown]
    body += [None, ["Total", "", *[sums[c] for c in counts], sums.cost]]
    return table([head, "Models", *[c.replace("_tokens", "").replace("_", " ").capitalize() for c in counts], "Cost (USD)"], body, [False, False] + [True] * (len(counts) + 1), 24 if compact else None)


def strip_costs(v, depth: int = 64):
    if depth and isinstance(v, dict):
        return {k: strip_costs(x, depth - 1) for k, x in v.items() if "cost" not in k.lower()}
    return [strip_costs(x, depth - 1) for x in v] if depth and isinstance(v, list) else v


def pick(doc, path: str | None):
    """A path of names, [n] and [] steps, such as ``.daily[].date``; after bars also ``length``, ``keys``, ``add`` and ``map(path)``."""
    if not path:
        return doc
    for stage in re.split(r"\s*\|\s*(?![^(]*\))", path.strip()):
        doc = _stage(doc, stage, path)
    return doc


def _stage(doc, stage: str, path: str):
    if stage == "length":
        return 0 if doc is None else len(doc) if isinstance(doc, (list, dict, str)) else abs(doc)
    if stage == "keys" and isinstance(doc, dict | list):
        return sorted(doc) if isinstance(doc, dict) else list(range(len(doc)))
    if stage == "add" and isinstance(doc, list | dict):
        values = [v for v in (doc.values() if isinstance(doc, dict) else doc) if v is not None]
        return (sum(values[1:], values[0]) if not isinstance(values[0], str) else "".join(values)) if values else None
    if m := re.fullmatch(r"map\((.*)\)", stage):
        return [pick(d, m[1]) for d in (doc or [])]
    if not re.fullmatch(r"(\.|(\.[A-Za-z_][\w]*|\[\d*\]|\.\[\d*\])+)", stage):
        raise ValueError(f"not a path: {path}")
    found, many = [doc], False
    for name, index in re.findall(r"\.([A-Za-z_]\w*)|\.?\[(\d*)\]", stage):
        if name:
            found = [d.get(name) if isinstance(d, dict) else None for d in found]
        elif index:
            found = [d[int(index)] if isinstance(d, list) and int(index) < len(d) else None for d in found]
        else:
            found, many = [x for d in found for x in (d.values() if isinstance(d, dict) else d or [])], True
    return found if many else found[0]


def dump(doc) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False)


def report_table(rows: DataFrame, totals: DataFrame, key: str = "date", compact: bool = False, breakdown: bool = False, color: bool = False) -> str:
    """Key, models, token columns and cost; then totals and what has no price."""
    shown = rows.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ([key, "agent"] if "agent" in rows.columns and key != "agent" else [key])], text.model_list(F.col("models_used")).alias("models"),
        *[text.human_number(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens", "total_tokens")], F.col("reasoning_tokens").alias("r"), text.currency(F.col("cost")).alias("cost"), "model_breakdowns",
    ).collect()
    t = totals.select(*[text.human_number(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens")], text.currency(F.col("cost")).alias("cost")).first()
    lead = [c for c in shown[0].asDict() if c in (key, "agent")] if shown else [key]
    middle = ["input_tokens", "output_tokens"] + ([] if compact else ["cache_creation_tokens", "cache_read_tokens"])
    if not compact and any(r.r for r in shown):
        middle.append("reasoning_tokens")
    middle.append("total_tokens")
    heads = [*[c.replace("_", " ").capitalize() for c in lead], "Models", *[c.replace("_tokens", "").replace("_", " ").capitalize() for c in middle], "Cost (USD)"]
    body: list[list[str] | None] = []
    for r in shown:
        body.append([*[r[c] for c in lead], r.models, *[r[c] for c in middle], r.cost])
        if breakdown:
            for m in r.model_breakdowns:
                body.append([*["" for _ in lead], f"└ {m.model}", *[f"{m[c]:,}" if c in m.asDict() else "" for c in middle], f"${m.cost:.2f}"])
    body += [None, ["Total", *["" for _ in lead[1:]], "", *[t[c] if c in t.asDict() else "0" for c in middle], t.cost]]
    missing = sorted({m.model for r in shown for m in r.model_breakdowns if m.missing})
    notes = "".join(f"\n{paint('No price for model', 'yellow', color)} {m}: its cost counts as 0" for m in missing)
    return table(heads, body, [False] * (len(lead) + 1) + [True] * (len(middle) + 1), 24 if compact else None) + notes


def blocks_table(found: DataFrame, limit: int, session_seconds: int | None = None) -> str:
    """Blocks with their burn rate, gaps between them, and the active one's projection."""
    from tokentally.operators import blocks as b

    shown = b.projection(b.burn_rate(found), limit).select(F.date_format("block_start", "yyyy-MM-dd HH:mm").alias("start"), text.human_number(F.col("tokens")).alias("tokens"), text.currency(F.coalesce("cost", F.lit(0.0))).alias("cost"), text.model_list(F.col("models")).alias("models"), F.concat(text.fixed(F.col("tokens_per_minute"), 0), F.lit(" t/m")).alias("rate"), "is_active", "remaining_minutes", "block_end", F.col("block_start").alias("at")).orderBy("at").collect()
    if not shown:
        return "No blocks found."
    body: list[list[str] | None] = []
    for i, r in enumerate(shown):
        if i and session_seconds and (r["at"] - shown[i - 1].block_end).total_seconds() > 2 * session_seconds:
            body.append(["—", "—", "—", "—", "—", "Gap"])
        body.append([r.start, r.tokens, r.cost, r.models or "—", r.rate, "Active" if r.is_active else "Complete"])
    left = next((f"\n\nActive block (limit: {limit:,} tokens): ~{r.remaining_minutes} min remaining" for r in shown if r.is_active), "")
    return table(["Block Start", "Tokens", "Cost (USD)", "Models", "Burn Rate", "Status"], body, [False, True, True, False, True, False]) + left


def blocks_json(found: DataFrame, gaps: DataFrame, limit: int, active_only: bool = False) -> str:
    from tokentally.operators import blocks as b

    rows = b.projection(b.burn_rate(found.where("is_active") if active_only else found), limit).orderBy("block_start")
    return dump({"blocks": report_rows(rows), "gaps": [] if active_only else report_rows(gaps), "tokenLimit": limit})


def statusline(found: DataFrame, now) -> str:
    """The active block in one line; ``now`` is a timestamp column, so that it can be fixed."""
    last = found.where("is_active").select(F.concat_ws(" │ ", F.concat(F.lit("⚡ "), F.array_join("models", ",")), text.currency(F.coalesce("cost", F.lit(0.0))), text.human_number(F.col("tokens")), dates.duration_text((F.unix_micros(now) - F.unix_micros("block_start")) / 1_000_000)).alias("line")).first()
    return last.line if last else "no data"
