"""OpenCode: messages in a SQLite database and in JSON files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.dates import date_in_zone, from_millis, zone
from tokentally.operators.dedup import first_wins
from tokentally.operators.report import filter_dates
from tokentally.plans.pricing import default_prices, price_by_candidates
from tokentally.schema import OPENCODE_MESSAGE, USAGE, canonical
from tokentally.sources.base import register
from tokentally.sources.files import Options, counts_ok, env_list, expand, has_files, strict_json, unique, whole_files
from tokentally.sources.sqlite import register_sqlite


def roots() -> list[Path]:
    return [p for p in unique([expand(p) for p in env_list("OPENCODE_DATA_DIR") or ["~/.local/share/opencode"]]) if p.is_dir()]


def database(root: Path) -> Path | None:
    """opencode.db, else the first opencode-<channel>.db."""
    return root / "opencode.db" if (root / "opencode.db").is_file() else next(iter(sorted(root.glob("opencode-*.db"))), None)


def parse_opencode(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """Canonical records plus ``provider``, from messages (value, and id and session_id of the database or null).

    A message needs tokens, a model, a provider, a time and a usage that isn't all
    zero; a total without parts is output.  The database's ids hold before the JSON's.
    """
    j = strict_json(raw, "value", OPENCODE_MESSAGE)
    t = "j.tokens"
    whole = lambda c: F.coalesce(F.floor(F.col(c)).cast("bigint"), F.lit(0))
    parts = [whole(f"{t}.{c}") for c in ("input", "output", "cache.write", "cache.read")]
    total = whole(f"{t}.total")
    none = parts[0] + parts[1] + parts[2] + parts[3] == 0
    output = F.when(none, total).otherwise(parts[1])
    ts = from_millis(F.col("j.time.created"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    own = j.where(F.col(t).isNotNull() & filled("j.modelID").isNotNull() & filled("j.providerID").isNotNull() & F.col("j.time.created").isNotNull() & counts_ok(*parts, total) & ~(none & (total == 0)))
    return canonical(
        own.select(
            F.lit("opencode").alias("agent"), ts.alias("ts"), date_in_zone(ts, tz).alias("date"), F.coalesce(filled("session_id"), filled("j.sessionID"), F.lit("unknown")).alias("session_id"), F.lit("opencode").alias("project"), F.lit("OpenCode").alias("project_path"),
            F.coalesce(filled("id"), filled("j.id")).alias("message_id"), F.col("j.modelID").alias("model"), F.col("j.modelID").alias("price_model"), parts[0].alias("input_tokens"), output.alias("output_tokens"),
            parts[2].alias("cache_creation_tokens"), parts[3].alias("cache_read_tokens"), F.col("j.cost").alias("logged_cost"), "file_path", "file_block_start", "row_id", F.col("j.providerID").alias("version"),
        )
    ).withColumnRenamed("version", "provider")


class OpenCodeSource:
    name = "opencode"

    def paths(self) -> list[str]:
        return [str(p) for p in roots()]

    def available(self) -> bool:
        return any(database(p) or has_files([p / "storage" / "message"], "*.json") for p in roots())

    def read(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None) -> DataFrame:
        """Of messages with one id the first is kept: earlier folders first, the database before the files."""
        o = options or Options()
        register_sqlite(spark)
        frames = []
        for k, root in enumerate([Path(p) for p in paths] if paths is not None else roots()):
            db = database(root)
            if db:
                rows = spark.read.format("tokentally_sqlite").schema("id string, session_id string, data string").options(path=str(db), table="message", pushFilters="true").load().where("data IS NOT NULL")
                frames.append(rows.select(F.col("data").alias("value"), "id", "session_id", F.lit(str(db)).alias("file_path"), F.lit(2 * k).cast("bigint").alias("file_block_start"), F.monotonically_increasing_id().alias("row_id")))
            if has_files([root / "storage" / "message"], "*.json"):
                docs = whole_files(spark, [str(root / "storage" / "message")], "*.json")
                frames.append(docs.select("value", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("session_id"), "file_path", F.lit(2 * k + 1).cast("bigint").alias("file_block_start"), "row_id"))
        if not frames:
            return spark.createDataFrame([], USAGE)
        raw = frames[0]
        for f in frames[1:]:
            raw = raw.unionByName(f)
        usage = first_wins(parse_opencode(raw.where("value IS NOT NULL"), zone(o.timezone)), "message_id", ["file_block_start", "file_path", "row_id"])
        prices = o.prices if o.prices is not None else default_prices(spark)
        priced = price_by_candidates(usage.withColumn("version", F.lit(None).cast("string")), prices)
        return filter_dates(canonical(priced), o.since, o.until)


register("opencode", OpenCodeSource)
