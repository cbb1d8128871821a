"""The Spark session that the engine's exact semantics need."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Otherwise a filter on _corrupt_record alone prunes the parsed schema, and mistyped lines pass.
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
}


def build_session(app: str = "tokentally", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return configure(builder.getOrCreate())


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tokentally-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    return base.rstrip("/")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that someone else made."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
