"""Price tables, model matching and cost expressions.

A price table has a row for each model.  A record's model is matched with it: the
exact name, else the longest key that contains, or is contained in, the name at word
boundaries.  Tables of usual size are matched within the record; beyond that distinct
models are resolved first, by an index of the names' words, and joined back by name.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "model string, input double, output double, cache_create double, cache_read double, cache_read_explicit boolean, input_above double, output_above double, cache_create_above double, cache_read_above double, multiplier double, context_limit bigint"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
TIER = 200_000
#: A resolved price map of up to this many models is broadcast; a larger one is joined by a shuffle.
BROADCAST_MODELS = 100_000
#: Price tables of up to this many keys are matched record by record.
MATCHED_KEYS = 512

# Built-in prices in dollars for a million tokens (input, output, cache creation, cache reads).
_BUILT_IN = {
    "claude-opus-4-5": (5, 25, 6.25, 0.5),
    "claude-opus-4-6": (5, 25, 6.25, 0.5),
    "claude-opus-4-7": (5, 25, 6.25, 0.5),
    "claude-opus-4-8": (5, 25, 6.25, 0.5),
    "claude-haiku-4-5": (1, 5, 1.25, 0.1),
    "claude-opus-4": (15, 75, 18.75, 1.5),
    "claude-sonnet-4-6": (3, 15, 3.75, 0.3),
    "claude-sonnet-4": (3, 15, 3.75, 0.3),
    "claude-3-5-haiku": (0.8, 4, 1, 0.08),
    "claude-3-5-haiku-20241022": (0.8, 4, 1, 0.08),
    "claude-3-opus": (15, 75, 18.75, 1.5),
    "claude-3-sonnet": (3, 15, 3.75, 0.3),
    "claude-3-haiku": (0.25, 1.25, 0.3, 0.03),
    "gpt-5": (1.25, 10, 1.25, 0.125),
    "gpt-5.5": (5, 30, 5, 0.5),
    "grok-4.3": (1.25, 2.5, 1.25, 0.125),
    "moonshot/kimi-k2.5": (0.6, 3, 0.75, 0.1),
    "moonshot/kimi-k2.6": (0.95, 4, 1.1875, 0.16),
    "gpt-5.1": (1.25, 10, 1.25, 0.125),
    "gpt-5.1-codex": (1.25, 10, 1.25, 0.125),
    "gpt-5.2": (1.75, 14, 1.75, 0.175),
    "gpt-5.2-codex": (1.75, 14, 1.75, 0.175),
    "gpt-5.3-codex": (1.75, 14, 1.75, 0.175),
    "gpt-5.4": (2.5, 15, 2.5, 0.25),
    "gpt-5.4-mini": (0.75, 4.5, 0.75, 0.075),
    "gpt-5.4-nano": (0.2, 1.25, 0.2, 0.02),
    "glm-4.5": (0.6, 2.2, 0, 0.11),
    "glm-4.6": (0.6, 2.2, 0, 0.11),
    "glm-4.7": (0.6, 2.2, 0, 0.11),
    "glm-5": (1, 3.2, 0, 0.2),
    "glm-5-turbo": (1.2, 4, 0, 0.24),
    "glm-5.1": (1.4, 4.4, 0, 0.26),
    "zai/glm-4.5": (0.6, 2.2, 0, 0.11),
    "zai/glm-4.5-x": (2.2, 8.9, 0, 0.45),
    "zai/glm-4.5-air": (0.2, 1.1, 0, 0.03),
    "zai/glm-4.5-airx": (1.1, 4.5, 0, 0.22),
    "zai/glm-4.5v": (0.6, 1.8, 0, 0.11),
    "zai/glm-4.5-flash": (0, 0, 0, 0),
    "zai/glm-4-32b-0414-128k": (0.1, 0.1, 0, 0),
    "deepseek-v4-pro": (0.435, 0.87, 0.54375, 0.003625),
    "qwen3.6-plus": (0.325, 1.95, 0.35, 0.028),
    "qwen3.6-plus-2026-04-02": (0.325, 1.95, 0.35, 0.028),
    "qwen3-coder-plus": (1, 5, 1.25, 0.1),
    "qwen/qwen3-coder-480b-a35b-instruct": (0.29, 1.2, 0.3625, 0.029),
}
# The one built-in model with prices above 200,000 tokens, and the one whose cache price is implied.
_ABOVE = {"claude-sonnet-4": (6, 22.5, 7.5, 0.6)}
_IMPLIED_CACHE = {"grok-4.3"}
# Context limits.
_LIMITS = {
    "claude-opus-4-5": 200_000,
    "claude-opus-4-6": 1_000_000,
    "claude-opus-4-7": 1_000_000,
    "claude-opus-4-8": 1_000_000,
    "claude-haiku-4-5": 200_000,
    "claude-opus-4": 200_000,
    "claude-sonnet-4-6": 1_000_000,
    "claude-sonnet-4": 200_000,
    "claude-3-5-haiku": 200_000,
    "claude-3-5-haiku-20241022": 200_000,
    "claude-3-opus": 200_000,
    "claude-3-sonnet": 200_000,
    "claude-3-haiku": 200_000,
    "gpt-5.5": 1_050_000,
    "grok-4.3": 1_000_000,
    "moonshot/kimi-k2.5": 262_144,
    "moonshot/kimi-k2.6": 262_144,
    "gpt-5.4": 1_050_000,
    "deepseek-v4-pro": 1_048_576,
    "qwen3.6-plus": 1_000_000,
    "qwen3.6-plus-2026-04-02": 1_000_000,
    "qwen3-coder-plus": 1_000_000,
    "qwen/qwen3-coder-480b-a35b-instruct": 262_144,
}
# What fast mode costs, by name, or by the end of a part of the name.
FAST_EXACT = {"gpt-5.5": 2.5, "gpt-5.4": 2.0, "gpt-5.3-codex": 2.0}
FAST_BASES = {"claude-opus-4-6": 6.0, "claude-opus-4-7": 6.0, "claude-opus-4-8": 2.0}
# The one alias, tried after both matches.
ALIASES = {"gpt-5.3-spark": "gpt-5.3-codex-spark"}


def fast_multiplier(model: Column) -> Column:
    """0 where fast mode has no price of its own."""
    out = F.lit(0.0)
    for base, m in FAST_BASES.items():
        # A part between slashes and colons in which the last occurrence of the base ends it or is followed by a dash.
        out = F.when(normalised(model).rlike(rf"(^|[/:])[^/:]*{base}(?![^/:]*{base})(-[^/:]*)?($|[/:])"), m).otherwise(out)
    for name, m in FAST_EXACT.items():
        out = F.when(model == name, m).otherwise(out)
    return out


def normalised(c: Column) -> Column:
    return F.translate(c, ".@", "--")


def price_table(df: DataFrame) -> DataFrame:
    """A table from model, input, output and any of the optional columns, defaults filled in: cache creation 1.25 times and cache reads 0.1 times the input price, and fast multipliers by name."""
    have = set(df.columns)
    opt = lambda c, t="double": (F.col(c) if c in have else F.lit(None)).cast(t)
    fast = F.coalesce(opt("multiplier"), fast_multiplier(F.col("model")))
    return df.where("model IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL").select(
        "model", F.col("input").cast("double"), F.col("output").cast("double"),
        F.coalesce(opt("cache_create"), F.col("input") * 1.25).alias("cache_create"), F.coalesce(opt("cache_read"), F.col("input") * 0.1).alias("cache_read"),
        F.coalesce(opt("cache_read_explicit", "boolean"), opt("cache_read").isNotNull()).alias("cache_read_explicit"),
        *[opt(c).alias(c) for c in ("input_above", "output_above", "cache_create_above", "cache_read_above")],
        F.when(fast == 0, 1.0).otherwise(fast).alias("multiplier"), opt("context_limit", "bigint").alias("context_limit"),
    )


def built_in(spark: SparkSession) -> DataFrame:
    rows = []
    for model, p in _BUILT_IN.items():
        above = _ABOVE.get(model, (None,) * 4)
        rows.append((model, *[x / 1e6 for x in p], model not in _IMPLIED_CACHE, *[x / 1e6 if x is not None else None for x in above], None, _LIMITS.get(model)))
    return price_table(spark.createDataFrame(rows, COLUMNS))


def from_config(spark: SparkSession, path_or_text: str) -> DataFrame:
    """The ``pricing`` object of a config: {model: {input, output, cacheRead?, cacheCreate? or cacheCreation?, inputAbove200K?, outputAbove200K?, fastMultiplier?, contextLimit?}}."""
    entry = "struct<input: double, output: double, cacheRead: double, cacheCreate: double, cacheCreation: double, inputAbove200K: double, outputAbove200K: double, fastMultiplier: double, contextLimit: bigint>"
    rows = _document(spark, path_or_text).select(F.explode(F.from_json("value", f"pricing map<string, {entry}>")["pricing"]).alias("model", "e"))
    fast = F.when(F.col("e.fastMultiplier") == 0, 1.0).otherwise(F.col("e.fastMultiplier"))
    return price_table(rows.select("model", F.coalesce("e.input", F.lit(0.0)).alias("input"), F.coalesce("e.output", F.lit(0.0)).alias("output"), F.coalesce("e.cacheCreate", "e.cacheCreation").alias("cache_create"), F.col("e.cacheRead").alias("cache_read"), F.col("e.inputAbove200K").alias("input_above"), F.col("e.outputAbove200K").alias("output_above"), fast.alias("multiplier"), F.col("e.contextLimit").alias("context_limit")))


def from_litellm(spark: SparkSession, path_or_text: str) -> DataFrame:
    """Both shapes of a cost map: full names, or i, o, cc, cr, ia, oa, cca, cra, ctx, fast; a model needs input and output."""
    entry = """struct<input_cost_per_token: double, output_cost_per_token: double, cache_creation_input_token_cost: double, cache_read_input_token_cost: double,
    input_cost_per_token_above_200k_tokens: double, output_cost_per_token_above_200k_tokens: double, cache_creation_input_token_cost_above_200k_tokens: double,
    cache_read_input_token_cost_above_200k_tokens: double, max_input_tokens: bigint, provider_specific_entry: struct<fast: double>,
    i: double, o: double, cc: double, cr: double, ia: double, oa: double, cca: double, cra: double, ctx: bigint, fast: double>"""
    rows = _document(spark, path_or_text).select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("model", "e"))
    compact = F.col("e.i").isNotNull() & F.col("e.o").isNotNull()
    pick = lambda short, full: F.when(compact, F.col(f"e.{short}")).otherwise(F.col(f"e.{full}"))
    names = {"input": ("i", "input_cost_per_token"), "output": ("o", "output_cost_per_token"), "cache_create": ("cc", "cache_creation_input_token_cost"), "cache_read": ("cr", "cache_read_input_token_cost"), "input_above": ("ia", "input_cost_per_token_above_200k_tokens"), "output_above": ("oa", "output_cost_per_token_above_200k_tokens"), "cache_create_above": ("cca", "cache_creation_input_token_cost_above_200k_tokens"), "cache_read_above": ("cra", "cache_read_input_token_cost_above_200k_tokens"), "context_limit": ("ctx", "max_input_tokens"), "multiplier": ("fast", "provider_specific_entry.fast")}
    return price_table(rows.select("model", *[pick(*v).alias(k) for k, v in names.items()]))


def from_models_dev(spark: SparkSession, path_or_text: str) -> DataFrame:
    """Prices for a million tokens, by provider or flat."""
    model = "struct<id: string, cost: struct<input: double, output: double, cache_read: double, cache_write: double>, limit: struct<context: bigint>>"
    doc = _document(spark, path_or_text)
    nested = doc.select(F.explode(F.from_json("value", f"map<string, struct<models: map<string, {model}>>>")).alias("provider", "p")).where("p.models IS NOT NULL").select(F.explode("p.models").alias("key", "e"))
    flat = doc.select(F.explode(F.from_json("value", f"map<string, {model}>")).alias("key", "e"))
    rows = nested.unionByName(flat).where("e.cost.input IS NOT NULL AND e.cost.output IS NOT NULL")
    per = lambda c: F.col(f"e.cost.{c}") / 1_000_000
    table = rows.select(F.coalesce("e.id", "key").alias("model"), per("input").alias("input"), per("output").alias("output"), per("cache_write").alias("cache_create"), per("cache_read").alias("cache_read"), F.lit(1.0).alias("multiplier"), F.col("e.limit.context").alias("context_limit"))
    return price_table(table.dropDuplicates(["model"]))


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Prices for a million tokens from columns model, input, output and optionally cache_read, cache_create; a model's first row holds."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    per = lambda c: ((F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")) / 1_000_000).alias(c)
    numbered = raw.withColumn("_n", F.monotonically_increasing_id())
    first = numbered.groupBy(F.trim("model").alias("model")).agg(F.min_by(F.struct(*[c for c in raw.columns if c != "model"]), "_n").alias("r")).select("model", "r.*")
    return price_table(first.select("model", per("input"), per("output"), per("cache_read"), per("cache_create")))


def price_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """model, change (added, removed, updated) between two price tables."""
    values = [c for c in NAMES if c != "model"]
    a, b = old.select("model", F.struct(*values).alias("before")), new.select("model", F.struct(*values).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "updated")
    return a.join(b, "model", "full_outer").select("model", change.alias("change")).where("change IS NOT NULL")


def fill_missing(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, and of ``second`` the models (and context limits) that it lacks."""
    limits = second.where("context_limit IS NOT NULL").select("model", F.col("context_limit").alias("_limit"))
    own = first.join(limits, "model", "left").withColumn("context_limit", F.coalesce("context_limit", "_limit")).drop("_limit")
    return own.select(*NAMES).unionByName(second.join(first, "model", "left_anti").select(*NAMES))


def apply_overrides(prices: DataFrame, overrides: DataFrame) -> DataFrame:
    """Field by field; a new input price scales implied cache prices with it.  ``overrides``: model and any price columns."""
    have = set(overrides.columns)
    o = lambda c: F.col(f"o.{c}") if c in have else F.lit(None)
    base_input = F.coalesce("p.input", F.lit(0.0))
    explicit = F.coalesce("p.cache_read_explicit", F.lit(False))
    scale = F.when(o("input").isNotNull() & (base_input > 0) & ~explicit, o("input") / base_input)
    scaled = lambda c: F.coalesce(o(c), F.when(F.col(f"p.{c}") > 0, F.col(f"p.{c}") * scale), F.col(f"p.{c}"))
    j = prices.alias("p").join(overrides.alias("o"), F.col("p.model") == F.col("o.model"), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        F.coalesce("p.model", "o.model").alias("model"), zero(F.coalesce(o("input"), "p.input")).alias("input"), zero(F.coalesce(o("output"), "p.output")).alias("output"),
        zero(scaled("cache_create")).alias("cache_create"), zero(scaled("cache_read")).alias("cache_read"), (o("cache_read").isNotNull() | explicit).alias("cache_read_explicit"),
        F.coalesce(o("input_above"), "p.input_above").alias("input_above"), F.coalesce(o("output_above"), "p.output_above").alias("output_above"),
        scaled("cache_create_above").alias("cache_create_above"), scaled("cache_read_above").alias("cache_read_above"),
        F.coalesce(o("multiplier"), F.col("p.multiplier"), F.lit(1.0)).alias("multiplier"), F.coalesce(o("context_limit"), "p.context_limit").cast("bigint").alias("context_limit"),
    )


def default_prices(spark: SparkSession, config: str | None = None) -> DataFrame:
    """The config's prices, gaps filled with the built-in ones."""
    return fill_missing(from_config(spark, config), built_in(spark)) if config else built_in(spark)


def _document(spark: SparkSession, path_or_text: str) -> DataFrame:
    """One JSON document as one row (value)."""
    if path_or_text.lstrip()[:1] == "{":
        return spark.createDataFrame([(json.dumps(json.loads(path_or_text)),)], "value string")
    return spark.read.text(path_or_text, wholetext=True)


def _pattern(key: str) -> str:
    """occurs() of a known key."""
    escaped = re.sub(r"([^A-Za-z0-9])", r"\\\1", key)
    return rf"(?<![A-Za-z0-9]){escaped}(?![A-Za-z0-9])" + (r"(?![-.][0-9])" if re.search("[0-9]$", key) else "")


def occurs(key: Column, value: Column) -> Column:
    """Whether ``key`` stands in ``value`` between non-alphanumerics; after a key's last digit no ``-`` or ``.`` with a digit may follow."""
    escaped = F.regexp_replace(key, r"([^A-Za-z0-9])", r"\\$1")
    tail = F.when(key.rlike("[0-9]$"), F.lit(r"(?![-.][0-9])")).otherwise("")
    return F.rlike(value, F.concat(F.lit(r"(?<![A-Za-z0-9])"), escaped, F.lit(r"(?![A-Za-z0-9])"), tail))


def matches(model: Column, key: Column) -> Column:
    """Either contains the other, as written or with dots and at signs as dashes."""
    a, b = normalised(model), normalised(key)
    return occurs(key, model) | occurs(model, key) | occurs(b, a) | occurs(a, b)


def _words(c: Column) -> Column:
    """The distinct runs of letters and digits in a name; a name without any has the empty one."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the price table: joined by sorting, which spills.  A million short names shuffle so few bytes that Spark would send them to every executor, and the driver lacks the memory to build that."""
    return df.hint("merge")


def candidate_pairs(names: DataFrame, keys: DataFrame) -> DataFrame:
    """name, key of all pairs that matches() may hold for, by an index of words.

    A name that stands in another between non-alphanumerics has all its words in it, also its rarest
    one.  So keys meet names by the key's rarest word, and names meet keys by the name's: two joins by word, whose
    postings are as short as rare words make them, instead of a comparison of all pairs.
    """
    name_words = names.select("name", F.explode(F.array_union(_words(F.col("name")), F.array(F.lit("")))).alias("word"))
    key_words = keys.select("key", F.explode(F.array_union(_words(F.col("key")), F.array(F.lit("")))).alias("word"))
    often = key_words.groupBy("word").agg(F.count("*").alias("often"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        own = df.select(c, F.explode(_words(F.col(c))).alias("word")).join(unsent(often), "word", "left")
        # A word that no key has is in no key's name: such a name can't stand in a key.
        return own.groupBy(c).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")).alias("w")).where("w.often > 0").select(c, F.col("w.word").alias("word"))

    inside = name_words.join(unsent(rarest(keys, "key")), "word").select("name", "key")
    around = unsent(rarest(names, "name")).join(key_words, "word").select("name", "key")
    return inside.unionByName(around).distinct()


def resolve(models: DataFrame, prices: DataFrame, match_dated_models: bool = False) -> DataFrame:
    """model, key: each distinct non-empty model's price key, if there is one.

    The exact name first, then the longest matching key (ties: the alphabetically
    first), then both for the model's alias.  With ``match_dated_models`` an
    eight-digit date at the end of a name is left out of the fuzzy match.
    """
    own = models.select(F.col(models.columns[0]).alias("model")).where("model IS NOT NULL AND model != ''").distinct()
    keys = prices.select(F.col("model").alias("key"))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    names = own.select("model", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("turn"), F.col("model").alias("name")), F.struct(F.lit(1).alias("turn"), F.try_element_at(alias, F.col("model")).alias("name"))), lambda s: s["name"].isNotNull())).alias("s")).select("model", "s.turn", "s.name")
    exact = names.join(unsent(keys), F.col("name") == F.col("key")).select("model", "turn", F.lit(0).alias("fuzzy"), "key")
    plain = F.regexp_replace("name", r"-[0-9]{8}$", "") if match_dated_models else F.col("name")
    plain_names = names.withColumn("name", plain)
    pairs = candidate_pairs(plain_names.select("name").distinct(), keys).where(matches(F.col("name"), F.col("key")))
    fuzzy = plain_names.join(unsent(pairs), "name").select("model", "turn", F.lit(1).alias("fuzzy"), "key")
    best = F.min(F.struct("turn", "fuzzy", (-F.length("key")).alias("short"), "key"))
    return exact.unionByName(fuzzy).groupBy("model").agg(best.alias("b")).select("model", F.col("b.key").alias("key"))


def tiered(n: Column, rate: Column, above: Column) -> Column:
    """Tokens beyond 200,000 at the rate above, if there is one."""
    n = n.cast("double")
    return F.when((n <= TIER) | above.isNull(), n * rate).otherwise(TIER * rate + (n - TIER) * above)


def record_cost(p: str = "", fast: Column | None = None) -> Column:
    """Cost of a record joined with its price (columns prefixed with ``p``); without a price 0.

    The multiplier holds for every record, or only where ``fast`` is true.
    """
    c = lambda n: F.col(f"{p}{n}")
    parts = [("input_tokens", "input"), ("output_tokens", "output"), ("cache_creation_tokens", "cache_create"), ("cache_read_tokens", "cache_read")]
    total = sum((tiered(F.coalesce(t, F.lit(0)), c(r), c(f"{r}_above")) for t, r in parts), F.lit(0.0))
    m = c("multiplier") if fast is None else F.when(fast, c("multiplier")).otherwise(1.0)
    return F.coalesce(F.when(m == 1, total).otherwise(F.round(total * m * 1e8) / 1e8), F.lit(0.0))


def cached_cost(p: str = "", fast: bool = False) -> Column:
    """Non-cached input, cached input (at the input rate unless cache reads have a price) and output; fast mode multiplies, by 2 where no multiplier is set."""
    c = lambda n: F.col(f"{p}{n}")
    plain = F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0))
    rate = F.when(c("cache_read_explicit"), c("cache_read")).otherwise(c("input"))
    total = plain * c("input") + F.col("cached_tokens") * rate + F.col("output_tokens") * c("output")
    return F.coalesce(total * (F.when(c("multiplier") == 1, 2.0).otherwise(c("multiplier")) if fast else F.lit(1.0)), F.lit(0.0))


def small_table(prices: DataFrame) -> dict[str, dict] | None:
    """The price table on the driver, by model, if it has MATCHED_KEYS rows at most; price tables are configuration."""
    found = prices.select(*NAMES).limit(MATCHED_KEYS + 1).collect()
    return {r.model: r.asDict() for r in found} if len(found) <= MATCHED_KEYS else None


def price_key(model: Column, keys: list[str], match_dated_models: bool = False) -> Column:
    """What resolve() finds for a record's model among a few keys, as an expression: no pass over the distinct models, no shuffle.

    Most names are keys themselves; others are compared with the keys that contain
    them, or that they contain, longest first.
    """
    if not keys:
        return F.lit(None).cast("string")
    flat_key = lambda k: k.translate(str.maketrans(".@", "--"))
    ranked = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(flat_key(k)).alias("flat"), F.lit(_pattern(k)).alias("found"), F.lit(_pattern(flat_key(k))).alias("flat_found")) for k in sorted(keys, key=lambda k: (-len(k), k))])

    def fits(n: Column, k: Column) -> Column:
        inside = F.contains(n["flat"], k["flat"]) & (F.rlike(n["plain"], k["found"]) | F.rlike(n["flat"], k["flat_found"]))
        return inside | (F.contains(k["flat"], n["flat"]) & (occurs(n["plain"], k["key"]) | occurs(n["flat"], k["flat"])))

    def fuzzy(name: Column) -> Column:
        plain = F.regexp_replace(name, r"-[0-9]{8}$", "") if match_dated_models else name
        # An array of one, so that the name is rewritten once and not for each key.
        one = F.array(F.struct(plain.alias("plain"), normalised(plain).alias("flat")))
        return F.element_at(F.transform(one, lambda n: F.try_element_at(F.filter(ranked, lambda k: fits(n, k)), F.lit(1))["key"]), 1)

    own = F.coalesce(F.when(model.isin(keys), model), fuzzy(model), *[F.when(model == a, F.lit(t) if t in keys else fuzzy(F.lit(t))) for a, t in ALIASES.items()])
    return F.when(model != "", own)


def with_prices(records: DataFrame, prices: DataFrame, model: str = "price_model", match_dated_models: bool = False, prefix: str = "price_") -> DataFrame:
    """``records`` left-joined with their models' prices, columns prefixed.

    The price table's own size decides: up to MATCHED_KEYS keys are matched within
    the record and broadcast, so records are read once and not shuffled.  A larger table is
    matched with the distinct models, which takes a pass over their column.
    """
    names = {c: f"{prefix}{c}" for c in NAMES if c != "model"}
    table = small_table(prices)
    if table is None and records.isStreaming:
        raise ValueError(f"a stream needs a price table of {MATCHED_KEYS} keys at most")
    if table is not None:
        known = F.broadcast(prices.select(F.col("model").alias("_m"), *[F.col(a).alias(b) for a, b in names.items()], F.lit(True).alias(f"{prefix}known")))
        return records.withColumn("_k", price_key(F.col(model), list(table), match_dated_models)).join(known, F.col("_k") == F.col("_m"), "left").drop("_k", "_m")
    found = records.select(F.col(model).alias("model")).distinct().limit(BROADCAST_MODELS + 1).collect()
    few = len(found) <= BROADCAST_MODELS
    models = records.sparkSession.createDataFrame([(r.model,) for r in found], "model string") if few else records.select(F.col(model).alias("model"))
    known = resolve(models, prices, match_dated_models).join(unsent(prices.withColumnRenamed("model", "key")), "key").select(F.col("model").alias("_m"), *[F.col(a).alias(b) for a, b in names.items()], F.lit(True).alias(f"{prefix}known"))
    known = F.broadcast(known) if few else unsent(known)
    return records.join(known, records[model] == F.col("_m"), "left").drop("_m")


def price_usage(usage: DataFrame, prices: DataFrame, precedence: str = "computed", fast_multiplier_when: str = "always", match_dated_models: bool = False) -> DataFrame:
    """Fill cost and missing_pricing_model of canonical records.

    precedence: ``computed`` ignores logged costs, ``logged`` prefers a logged
    cost other than 0, ``positive`` one above 0.  fast_multiplier_when:
    ``always``, or ``when_fast`` for records in fast mode only.
    """
    j = with_prices(usage, prices, "price_model", match_dated_models)
    cost = record_cost("price_", (F.col("speed") == "fast") if fast_multiplier_when == "when_fast" else None)
    logged = {"computed": F.lit(False), "logged": F.coalesce("logged_cost", F.lit(0.0)) != 0, "positive": F.coalesce("logged_cost", F.lit(0.0)) > 0}[precedence]
    missing = F.when(F.col("price_model").isNotNull() & (F.col("price_model") != "") & F.col("price_known").isNull() & (F.lit(precedence != "positive") | ~logged), F.col("price_model"))
    return j.withColumn("cost", F.when(logged, F.col("logged_cost")).otherwise(cost)).withColumn("missing_pricing_model", missing).select(*usage.columns)


def context_limits(models: DataFrame, prices: DataFrame) -> DataFrame:
    """model, context_limit, matched among the models that have a limit."""
    own = prices.where("context_limit IS NOT NULL")
    return resolve(models, own).join(own.withColumnRenamed("model", "key").select("key", "context_limit"), "key").select("model", "context_limit")


def candidates(model: Column, provider: Column) -> Column:
    """The names to try in order: renamed, with the version dashed, and each with the provider before it."""
    renamed = F.when(model == "gemini-3-pro-high", "gemini-3-pro-preview").when(model == "k2p6", "kimi-k2.6").otherwise(model)
    family = r"^(claude-(?:haiku|opus|sonnet)-)"
    dashed = F.when(renamed.rlike(family + r"[0-9]*\.[0-9]"), F.regexp_replace(renamed, family + r"([0-9]*)\.([0-9].*)$", "$1$2-$3")).when(renamed.rlike(family + "[0-9]{2}"), F.regexp_replace(renamed, family + "([0-9])([0-9].*)$", "$1$2-$3")).otherwise(renamed)
    lead = F.concat(F.translate(provider, "-", "_"), F.lit("/"))
    base = F.array(renamed, dashed)
    return F.array_distinct(F.when(provider == "unknown", base).otherwise(F.concat(base, F.transform(base, lambda b: F.concat(lead, b)))))


def price_by_candidates(records: DataFrame, prices: DataFrame, provider: str = "provider") -> DataFrame:
    """Cost of records whose model may be listed under several names: a logged cost above 0, else the first candidate's cost above 0, else 0.

    ``records`` are canonical with the provider's column.  A model has at most four
    candidates; a record meets the prices of its own only.
    """
    rates = ["input", "output", "cache_create", "cache_read", "input_above", "output_above", "cache_create_above", "cache_read_above", "multiplier"]
    table = small_table(prices)
    if table is not None:
        schema = f"map<string, struct<{', '.join(f'{r}: double' for r in rates)}>>"
        by_key = F.from_json(F.lit(json.dumps({k: {r: v[r] for r in rates} for k, v in table.items()})), schema)
        keys = F.transform(candidates(F.col("price_model"), F.col(provider)), lambda c: price_key(c, list(table)))
        listed = F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.try_element_at(by_key, k))
        j = records.withColumn("rates", F.when(F.size(listed) > 0, listed))
    else:
        pairs = records.select("price_model", provider).distinct().select("price_model", provider, F.posexplode(candidates(F.col("price_model"), F.col(provider))).alias("pos", "name"))
        found = resolve(pairs.select("name"), prices).withColumnRenamed("model", "name").join(prices.withColumnRenamed("model", "key"), "key")
        priced = pairs.join(found, "name").groupBy("price_model", provider).agg(F.array_sort(F.collect_list(F.struct("pos", *rates))).alias("rates"))  # at most four
        j = records.join(priced, ["price_model", provider], "left")
    use = [F.col("input_tokens"), F.col("output_tokens") + F.col("extra_tokens"), F.col("cache_creation_tokens"), F.col("cache_read_tokens")]

    def cost(r: Column) -> Column:
        total = sum((tiered(F.coalesce(n, F.lit(0)), r[k], r[f"{k}_above"]) for n, k in zip(use, rates[:4], strict=True)), F.lit(0.0))
        return F.when(r["multiplier"] == 1, total).otherwise(F.round(total * r["multiplier"] * 1e8) / 1e8)

    first = F.try_element_at(F.filter(F.transform("rates", cost), lambda c: c > 0), F.lit(1))
    logged = F.coalesce("logged_cost", F.lit(0.0)) > 0
    total = sum((F.col(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")), F.lit(0))
    return j.withColumn("cost", F.when(logged, F.col("logged_cost")).otherwise(F.coalesce(first, F.lit(0.0)))).withColumn("missing_pricing_model", F.when(~logged & (total > 0) & F.col("rates").isNull(), F.col("model"))).select(*records.columns)
