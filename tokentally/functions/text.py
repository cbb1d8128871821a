"""Names, numbers and money as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, digits: int) -> Column:
    """``digits`` decimals of a non-negative double, rounded by its exact binary value, halves to the even digit.

    v times a power of ten is split into its rounded product and the exact error, so
    that the comparison with one half is exact.
    """
    scale = float(10**digits)
    split = v * 134217729.0
    high = split - (split - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    low = F.floor(product)
    over = (product - low - 0.5) + error
    n = F.when(over > 0, low + 1).when(over < 0, low).otherwise(low + low % 2).cast("bigint")
    if digits == 0:
        return n.cast("string")
    whole = F.floor(n / int(scale)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((n - whole * int(scale)).cast("string"), digits, "0"))


def scaled(v: Column, suffix: str) -> Column:
    """Two, one or no decimals by size; a trailing .0 goes."""
    s = F.when(v >= 100, fixed(v, 0)).when(v >= 10, fixed(v, 1)).otherwise(fixed(v, 2))
    return F.concat(F.regexp_replace(s, r"\.0$", ""), F.lit(suffix))


def human_number(c: Column) -> Column:
    """1,234 below 10,000; 12.3K, 1.23M, 1.00B above."""
    x = c.cast("double")
    return F.when(c >= 1_000_000_000, scaled(x / 1e9, "B")).when(c >= 1_000_000, scaled(x / 1e6, "M")).when(c >= 10_000, scaled(x / 1e3, "K")).otherwise(F.format_number(c, 0))


def currency(c: Column) -> Column:
    return F.concat(F.when(c < 0, "$-").otherwise("$"), fixed(F.abs(c), 2))


#: Vendor prefixes that display names go without.
VENDOR_PREFIXES = r"^((us|eu|global|jp|au)\.anthropic\.|anthropic[./]|openrouter/|vertex_ai/|bedrock/|openai/|azure/)+"


def short_model(c: Column) -> Column:
    return F.regexp_replace(c, VENDOR_PREFIXES, "")


def model_list(models: Column) -> Column:
    """Short names, distinct and sorted, one bullet a line."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(models, short_model))), lambda m: F.concat(F.lit("- "), m)), "\n")


def byte_size(c: Column) -> Column:
    x = c.cast("double")
    return F.when(c >= 1 << 30, F.format_string("%.1f GB", x / (1 << 30))).when(c >= 1 << 20, F.format_string("%.1f MB", x / (1 << 20))).when(c >= 1 << 10, F.format_string("%.1f KB", x / (1 << 10))).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def first_filled(*cs: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def parse_aliases(text: str | None) -> dict[str, str]:
    """``k=v,k2=v2``."""
    pairs = (p.strip().split("=", 1) for p in (text or "").split(","))
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2}


def project_name(path: Column, aliases: dict[str, str] | None = None) -> Column:
    """The path's alias, else that of the path with slashes, else its last part."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    last = F.element_at(F.split(norm, "/"), -1)
    if not aliases:
        return last
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(known, path), F.try_element_at(known, norm), last)


def is_version(c: Column) -> Column:
    """Absent, or digits.digits.digit at the start."""
    return c.isNull() | c.rlike(r"^[0-9]+\.[0-9]+\.[0-9]")


def null_guard(line: Column) -> Column:
    """Whether none of the fields that must not be null is ``:null`` in the text."""
    return ~line.rlike(r'"(id|cwd|model|speed|costUSD|version|sessionId|requestId|isApiErrorMessage|cache_read_input_tokens|cache_creation_input_tokens)":null')


def usage_limit_reset(line: Column) -> Column:
    """When a usage limit ends, from the epoch after the notice's bar."""
    n = F.regexp_extract(line, r"Claude AI usage limit reached[^|]*\|([0-9]{1,12})", 1).try_cast("bigint")
    return F.when(n > 0, F.timestamp_seconds(n))


def truncate_9(c: Column) -> Column:
    """Nine decimals, cut off; what is no finite number is 0."""
    x = F.abs(c) * 1e9
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.signum(c) * F.floor(x).cast("double") / 1e9)


#: agents' display names.
AGENT_NAMES = {
    "claude": "Claude Code", "codex": "Codex CLI", "opencode": "OpenCode", "amp": "Amp", "codebuff": "Codebuff", "copilot": "GitHub Copilot CLI", "droid": "Droid", "gemini": "Gemini CLI",
    "goose": "Goose", "hermes": "Hermes Agent", "kilo": "Kilo Code", "kimi": "Kimi CLI", "openclaw": "OpenClaw", "pi": "pi-agent", "qwen": "Qwen Code",
}


def agent_name(agent: str) -> str:
    return AGENT_NAMES.get(agent, agent)


def token_limit(text: str | None, default: int = 500_000) -> int:
    """A number, with K, M or B; nothing or nonsense means the default."""
    import re

    m = re.match(r"^\s*(\d+(?:\.\d+)?)\s*([kmb]?)", (text or "").lower())
    n = int(float(m[1]) * {"": 1, "k": 1_000, "m": 1_000_000, "b": 1_000_000_000}[m[2]]) if m else 0
    return n or default
