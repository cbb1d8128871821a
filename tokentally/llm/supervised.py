"""Labelled texts, bounded samples of them, and batch scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.shared import materialize, prepare, remainder


@dataclass
class Sample:
    """At most ``per_class`` texts of each label, and how rare each label is among all training labels."""

    texts: list[str]
    langs: list[str]
    labels: np.ndarray
    totals: tuple[int, int]

    def weights(self) -> tuple[float, float]:
        """How many training labels each sample document stands for, by label."""
        n = [max(1, int((self.labels == k).sum())) for k in (0, 1)]
        return max(1, self.totals[0]) / n[0], max(1, self.totals[1]) / n[1]

    def shift(self) -> float:
        """What a logit fitted on the sample needs for the labels' true odds."""
        n = [max(1, int((self.labels == k).sum())) for k in (0, 1)]
        t = [max(1, x) for x in self.totals]
        return math.log(t[1] / t[0]) - math.log(n[1] / n[0])


def labels_outside(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, label (0 or 1) outside the held-out fold.  Null ids and labels are skipped; of several labels of one id the largest holds."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
    return told.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, label, text, lang of all labelled documents outside the held-out fold, whole: a row for each id, of several with one id the smallest text."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    # One row for each id, summed up before the shuffle, and joined where it lies then.
    texts = texts.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"))
    return texts.join(labels_outside(labels, label, folds, held_out), "doc_id").select("doc_id", "label", "t.text", "t.lang")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int = 2000, max_chars: int = 100_000, class_chars: int = 25_000_000) -> Sample:
    """The labelled documents with the smallest hashes of their ids, outside the held-out fold.

    The bound is ``per_class`` documents of each label, each of at most ``max_chars``
    characters and together of ``class_chars``; longer ones are only left out of the
    sample, never of scoring.  Null ids and labels are skipped; of several labels of
    one id the largest holds; of several rows with one id the smallest text, so
    that repeated ids don't count more.  What comes to the driver is bounded by that.
    """
    prepare(docs.sparkSession)
    told = labels_outside(labels, label, folds, held_out)
    totals = {r.label: r.n for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]
    chosen = told.where("label = 0").orderBy(*order).limit(per_class).unionByName(told.where("label = 1").orderBy(*order).limit(per_class))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    # At most 2 * per_class ids: a broadcast of bounded size.  One row for each id, summed up before the shuffle.
    own = texts.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= max_chars)
    own = own.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "label", "t.text", "t.lang", order[0].alias("place"))
    own = materialize(own, "sample")
    last: list = []  # for each label the last place that the characters allow
    for k in (0, 1):
        size, at = 0, None
        for r in sorted(own.where(F.col("label") == k).select("place", "doc_id", F.length("text").alias("n")).collect()):
            size += r.n
            if size > class_chars:
                break
            at = (r.place, r.doc_id)
        if at:
            last.append((F.col("label") == k) & ((F.col("place") < at[0]) | ((F.col("place") == at[0]) & (F.col("doc_id") <= at[1]))))
    rows = own.where(last[0] if len(last) == 1 else last[0] | last[1]).collect() if last else []
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return Sample([r.text for r in rows], [r.lang for r in rows], np.array([r.label for r in rows], dtype=np.int64), (totals.get(0, 0), totals.get(1, 0)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def with_scores(docs: DataFrame, score: Callable[[list[str]], np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` without its text and with a score of each whole text; null texts count as empty, a column of the score's name is replaced, all others stay."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score(texts), pa.float64())], names=[*rest, name])

    fields = [docs.schema[c] for c in rest] + [T.StructField(name, T.DoubleType())]
    return docs.select(*rest, "text").mapInArrow(run, T.StructType(fields))


def keep_scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(score(texts) >= least))

    return docs.mapInArrow(run, docs.schema)
