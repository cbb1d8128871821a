"""Parquet tables read as usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.dates import date_in_zone
from tokentally.schema import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_usage(spark: SparkSession, sf_dir: str, tz: str = "UTC") -> DataFrame:
    """``events`` as a usage log: the event is the message, the user the session, the type the model; props' k is the input, value the output."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    value = F.coalesce("value", F.lit(0.0))
    return canonical(
        e.select(
            F.lit("events").alias("agent"), "ts", date_in_zone(F.col("ts"), tz).alias("date"), F.col("user_id").cast("string").alias("session_id"),
            F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"), F.concat(F.lit("/work/p"), (F.col("user_id") % 7).cast("string")).alias("project_path"),
            F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("model"), F.col("event_type").alias("price_model"),
            F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("input_tokens"), F.floor(value).cast("bigint").alias("output_tokens"),
            F.when(F.col("event_type") == "purchase", F.round(value / 100, 6)).alias("credits"), F.when(F.col("event_type") == "click", F.lit(1)).alias("message_count"), F.col("event_id").alias("row_id"),
        )
    )


def lineitem_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a usage log: quantities are tokens, the return flag the model, the ship mode's supplier the project."""
    li = table(spark, sf_dir, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    return canonical(
        li.select(
            F.lit("lineitem").alias("agent"), "ts", date_in_zone(F.col("ts")).alias("date"), F.col("l_orderkey").cast("string").alias("session_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("project"),
            F.col("l_orderkey").cast("string").alias("message_id"), F.col("l_linenumber").cast("string").alias("request_id"), F.col("l_returnflag").alias("model"), F.col("l_returnflag").alias("price_model"),
            F.col("l_quantity").cast("bigint").alias("input_tokens"), (F.col("l_quantity") * 2).cast("bigint").alias("output_tokens"), F.col("l_extendedprice").alias("cost"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        )
    )


def orders_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a usage log: an order is a message of its customer's session, its priority the model."""
    o = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return canonical(
        o.select(
            F.lit("orders").alias("agent"), "ts", date_in_zone(F.col("ts")).alias("date"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderstatus").alias("project"), F.col("o_orderkey").cast("string").alias("message_id"),
            F.col("o_orderpriority").alias("model"), F.col("o_orderpriority").alias("price_model"), F.lit(1).cast("bigint").alias("input_tokens"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("output_tokens"), F.col("o_totalprice").alias("cost"), F.col("o_orderkey").alias("row_id"),
        )
    )
