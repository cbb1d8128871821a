"""Where logs lie, and their lines."""

from __future__ import annotations

import datetime
import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.dates import bound


@dataclass
class Options:
    """What a source is read with."""

    prices: DataFrame | None = None
    timezone: str = "UTC"
    since: str | None = None
    until: str | None = None
    project: str | None = None
    match_dated_models: bool = False
    fast_multiplier_when: str = "always"


def expand(path: str) -> Path:
    return Path(path).expanduser()


def env_list(name: str) -> list[str]:
    """A comma list from the environment."""
    return [p.strip() for p in os.environ.get(name, "").split(",") if p.strip()]


def unique(paths: list[Path]) -> list[Path]:
    return list(dict.fromkeys(p for p in paths))


def has_files(paths: list[Path], pattern: str) -> bool:
    return any(next(p.rglob(pattern), None) is not None for p in paths if p.is_dir())


def modified_after(since: str | None) -> str | None:
    """Files last written before this hold nothing of ``since`` or later, whatever the zone: two days are left in between."""
    day = bound(since)
    if not day or not re.fullmatch(r"\d{8}", day):
        return None
    try:
        return (datetime.datetime.strptime(day, "%Y%m%d") - datetime.timedelta(days=2)).strftime("%Y-%m-%dT00:00:00")
    except (ValueError, OverflowError):
        return None


def lines(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl", since: str | None = None) -> DataFrame:
    """value, file_path, file_block_start, file_time, row_id of each non-empty line, in recursion; paths may be of any file system.

    Lines end at a newline alone; one carriage return before it goes.  row_id
    rises along each split of a file, so (file_path, file_block_start, row_id) is
    the order of the lines.  Large files are split by Spark and no line is lost at
    a split.  Without paths there are no lines.  Files that were last written before
    ``since`` (a date) aren't read.
    """
    schema = "value string, file_path string, file_block_start bigint, file_time timestamp, row_id bigint"
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n")
    oldest = modified_after(since)
    read = (reader.option("modifiedAfter", oldest) if oldest else reader).text(paths)
    m = F.col("_metadata")
    numbered = read.select(F.regexp_replace("value", r"\r$", "").alias("value"), m["file_path"].alias("file_path"), m["file_block_start"].alias("file_block_start"), m["file_modification_time"].alias("file_time"), F.monotonically_increasing_id().alias("row_id"))
    return numbered.where("value != ''").withColumn("file_path", F.url_decode("file_path"))


def file_names(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """file_path of each file, as lines() has it; contents aren't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    return read.select(F.url_decode(F.col("_metadata.file_path")).alias("file_path"))


def whole_files(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """One row for each file: value, file_path, file_block_start (0), row_id (0)."""
    if not paths:
        return spark.createDataFrame([], "value string, file_path string, file_block_start bigint, row_id bigint")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, wholetext=True)
    return read.select("value", F.url_decode(F.col("_metadata.file_path")).alias("file_path"), F.lit(0).cast("bigint").alias("file_block_start"), F.lit(0).cast("bigint").alias("row_id"))


def strict_json(df: DataFrame, column: str, schema: str, out: str = "j", keep: Column | None = None) -> DataFrame:
    """Parse JSON and drop rows with a field of another type, but for those to ``keep``: parts must then be kept whole (see the session's settings)."""
    parsed = df.withColumn(out, F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    own = F.col(out).isNotNull() & F.col(f"{out}._corrupt_record").isNull()
    return parsed.where(own if keep is None else own | keep)


def counts_ok(*cs: Column) -> Column:
    """No negative counts."""
    ok = F.lit(True)
    for c in cs:
        ok = ok & (F.coalesce(c, F.lit(0)) >= 0)
    return ok


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def path_parts(path: str | Column = "file_path") -> Column:
    """A file's path in parts, whichever slashes it has."""
    return F.split(F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/"), "/")
