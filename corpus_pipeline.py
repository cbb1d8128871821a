"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and
returns the documents it keeps, with the columns of ``documents``; the last one
returns the packed pieces.  Stages are written and read again in between, so each
one's plan starts at a table.

Every stage but the last keeps all columns of its input, also such whose names an
operator uses for itself, and gives an empty table for an empty one.  Rows that
repeat are decided each for itself, but in near_duplicates().  Texts are read whole,
however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokentally.llm.decontam import drop_leaks
from tokentally.llm.neardup import keep_one
from tokentally.llm.packing import pack_documents
from tokentally.llm.pii import pseudonymise
from tokentally.llm.quality import keep_quality, train_quality
from tokentally.llm.queries import PII_KEY, tokenizer_file
from tokentally.llm.shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 or more; a score of just 0.3 stays).

    It is trained on a bounded sample of the labels outside the held-out fold.  Null and
    empty texts have the score of the model's bias; null ids are scored like others.
    """
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Rows that repeat its id and text go, rows with its id and another text stay.  Rows
    without doc_id stay, so do null and empty texts, each by itself.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: no run of words within a quarter of the item's words in edits (items of one to three words: as they are).

    Null and empty texts stay; null items find nothing.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format; every document stays, a null text null, an empty one empty, and equal values get equal pseudonyms in all rows."""
    return pseudonymise(docs, PII_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens.

    Null and empty texts are a piece of the end id alone; rows that repeat are packed each
    for itself; pieces of one length are interchangeable; only longer documents are cut.
    """
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 2048, 0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", packing)]

#: SQL can't express the stages' models; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
