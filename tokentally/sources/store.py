"""The usage store: canonical records as Parquet, by date and agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokentally.operators.report import filter_dates
from tokentally.schema import USAGE

PARTITIONS = ["date", "agent"]


def write_usage(usage: DataFrame, folder: str) -> None:
    """Write records; each (date, agent) that occurs among them is replaced whole, all others stay as they are.

    Rows are rebalanced by date and agent, so a day is a few files, and a day that holds very many rows is
    split into more of them.  A load that breaks off leaves the days as they were.
    """
    spread = usage.select(*[f.name for f in USAGE.fields]).hint("rebalance", *PARTITIONS)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(folder)


def read_usage(spark: SparkSession, folder: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The store's records; dates narrow the folders that are listed and read."""
    stored = spark.read.schema(USAGE).parquet(folder)
    return filter_dates(stored, since, until).select(*[f.name for f in USAGE.fields])
