"""Schemas: the canonical usage record and the raw log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FIELDS = [
    ("agent", T.StringType()), ("ts", T.TimestampType()), ("date", T.StringType()), ("session_id", T.StringType()),
    ("project", T.StringType()), ("project_path", T.StringType()), ("message_id", T.StringType()), ("request_id", T.StringType()),
    ("version", T.StringType()), ("is_sidechain", T.BooleanType()), ("model", T.StringType()), ("price_model", T.StringType()),
    ("speed", T.StringType()), ("input_tokens", T.LongType()), ("output_tokens", T.LongType()), ("cache_creation_tokens", T.LongType()),
    ("cache_read_tokens", T.LongType()), ("reasoning_tokens", T.LongType()), ("extra_tokens", T.LongType()), ("logged_cost", T.DoubleType()),
    ("cost", T.DoubleType()), ("credits", T.DoubleType()), ("message_count", T.LongType()), ("missing_pricing_model", T.StringType()),
    ("file_path", T.StringType()), ("file_block_start", T.LongType()), ("row_id", T.LongType()),
]
USAGE = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
COUNTS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens", "extra_tokens")
#: A record's place among all records: first means smallest.
ORDER = ("file_path", "file_block_start", "row_id")

CLAUDE_LINE = """sessionId string, timestamp string, version string, costUSD double, requestId string, isApiErrorMessage boolean, isSidechain boolean,
message struct<id: string, model: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint,
cache_read_input_tokens: bigint, speed: string, cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>>>, _corrupt_record string"""
GENERIC_LINE = """timestamp string, sessionId string, costUSD double, message struct<model: string, usage: struct<input_tokens: bigint, output_tokens: bigint,
cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>>, _corrupt_record string"""
OPENCODE_MESSAGE = """id string, sessionID string, providerID string, modelID string, time struct<created: double>, cost double,
tokens struct<input: double, output: double, total: double, cache: struct<read: double, write: double>>, _corrupt_record string"""
_CODEX_USAGE = """struct<input_tokens: bigint, prompt_tokens: bigint, input: bigint, cached_input_tokens: bigint, cache_read_input_tokens: bigint, cached_tokens: bigint,
output_tokens: bigint, completion_tokens: bigint, output: bigint, reasoning_output_tokens: bigint, reasoning_tokens: bigint, total_tokens: bigint>"""
CODEX_LINE = f"timestamp string, created_at string, createdAt string, type string, payload string, model string, model_name string, metadata string, data string, result string, response string, usage {_CODEX_USAGE}, _corrupt_record string"
CODEX_PAYLOAD = f"type string, model string, model_name string, metadata string, info struct<last_token_usage: {_CODEX_USAGE}, total_token_usage: {_CODEX_USAGE}, model: string, model_name: string, metadata: string>"
CODEX_RESULT = f"timestamp string, created_at string, createdAt string, model string, model_name string, metadata string, usage {_CODEX_USAGE}"


def canonical(df: DataFrame) -> DataFrame:
    """All usage columns in order; those that ``df`` lacks are null (counts are 0)."""
    have = set(df.columns)
    zero = set(COUNTS)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(0 if f.name in zero else None).cast(f.dataType)).alias(f.name) for f in USAGE.fields])
