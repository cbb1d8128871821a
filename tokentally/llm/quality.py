"""Operator 7: quality classifier.

Logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as a sparse
dot product.  Each word counts in two views: its core (lower-cased, without
punctuation at its ends) and its shape (kind of letters plus the punctuation).
Unigrams and bigrams of both views are hashed into ``2 ** BITS`` weights, and
so is one mark for a word that repeats the one before it.  A feature's value is
its share of the document's words, so long and short documents compare.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.shared import AT_ONCE, Codes, hash64, mix64, per_process, release, remainder, segment_sums, segments, split_words
from tokentally.llm.supervised import Sample, keep_scored, sigmoid, training_sample, with_scores

BITS = 18
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = re.compile(r"[\w]+")


def _code(word: str) -> int:
    """48 bits of the core's hash and 16 of the shape's."""
    core = _ENDS.sub("", word)
    kind = "empty" if not core else "digits" if core.isdigit() else "upper" if core.isupper() and len(core) > 1 else "lower" if core.islower() else "title" if core.istitle() else "mixed"
    return hash64(core.lower()) >> 16 << 16 | hash64(kind + " " + _MARKS.sub("w", word)) >> 48


#: Where a long text is cut.
_CUT = re.compile("[\t-\r ]")


def features(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Groups of (weight index, document) arrays, and each document's number of words."""
    codes = per_process("quality codes", lambda: Codes(_code))
    words = [split_words(t) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    c = codes.of([x for w in words for x in w])
    doc = np.repeat(np.arange(len(texts)), n)
    core, shape = c >> np.uint64(16), c & np.uint64(0xFFFF)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    low = np.uint64(64 - BITS)
    index = lambda x, seed: (mix64(x, seed) >> low).astype(np.int64)
    with np.errstate(over="ignore"):
        pairs = core[:-1] * np.uint64(0x9E3779B97F4A7C15) + core[1:]
        shapes = (shape[:-1] << np.uint64(16)) | shape[1:]
    same = inner[core[inner] == core[inner + 1]]
    return [(index(core, 1), doc), (index(pairs[inner], 2), doc[inner]), (index(shape, 3), doc), (index(shapes[inner], 4), doc[inner]), (np.full(len(same), index(np.zeros(1, np.uint64), 5)[0]), doc[same])], n


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 of each text; a text without words has the bias alone."""
        if not texts:
            return np.zeros(0)
        total, n = self._sums([t if len(t) <= AT_ONCE else "" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > AT_ONCE:
                total[i], n[i] = self._long(t)
        return sigmoid(self.bias + total / np.maximum(n, 1))

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights, and numbers of words."""
        groups, n = features(texts)
        total = np.zeros(len(texts))
        for index, doc in groups:
            starts = np.searchsorted(doc, np.arange(len(texts) + 1))
            total += segment_sums(self.weights[index], starts)
        return total, n

    def _long(self, text: str) -> tuple[float, int]:
        """The same of one text, a piece at a time: each piece but the first is led by the last word before it, which counts once."""
        total, n, last = 0.0, 0, ""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + AT_ONCE)
            end = cut.start() if cut else len(text)
            piece = text[at:end]
            own = split_words(piece)
            if own:
                (more,), (k,) = self._sums([f"{last} {piece}" if last else piece])
                total, n = total + more, n + int(k)
                if last:
                    (once,), (k,) = self._sums([last])
                    total, n = total - once, n - int(k)
                last = own[-1]
            at = end
        return total, n


def fit(sample: Sample, alpha: float = 0.5, beta: float = 1e-4, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 4) -> QualityModel:
    """FTRL-proximal over the sample in a fixed shuffled order; the step follows each weight's own gradients."""
    size = 1 << BITS
    z, s = np.zeros(size), np.zeros(size)
    zb = sb = bias = 0.0
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []  # weights, how often each occurs, and the number of words; in 32 bits, which halves what the driver holds
    for i in range(0, len(sample.texts), 256):
        part = sample.texts[i : i + 256]
        groups, n = features(part)
        index, doc = (np.concatenate([g[k] for g in groups]) for k in (0, 1))
        order = np.argsort(doc, kind="stable")
        index, starts = index[order], segments(np.bincount(doc, minlength=len(part)))
        for k in range(len(part)):
            at, count = np.unique(index[starts[k] : starts[k + 1]], return_counts=True)
            rows.append((at.astype(np.int32), count.astype(np.int32), max(1, int(n[k]))))

    def current(zi: np.ndarray, si: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, count, words = rows[k]
            x = count / words
            w = current(z[at], s[at])
            p = sigmoid(np.array(bias + w @ x))
            g = float(p - sample.labels[k])
            gx = g * x
            sigma = (np.sqrt(s[at] + gx * gx) - np.sqrt(s[at])) / alpha
            z[at] += gx - sigma * w
            s[at] += gx * gx
            sigma = (np.sqrt(sb + g * g) - np.sqrt(sb)) / alpha
            zb += g - sigma * bias
            sb += g * g
            bias = -zb / ((1.0 + np.sqrt(sb)) / alpha)
    return QualityModel(current(z, s).astype(np.float32), float(bias) + sample.shift())


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> QualityModel:
    """Fit on a bounded sample (training_sample()) of rows outside the held-out fold.  Without labels every score is that of the bias, 0.5."""
    model = fit(training_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class))
    release("quality codes")
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` without text, plus ``score``; null and empty texts, repeated rows and any further columns are kept as rows of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_scores(docs, lambda texts: shared.value.score(texts))


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_scored(docs, lambda texts: shared.value.score(texts), threshold)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have the bias's score; rows that repeat are scored each for itself, a null id counts as
    the empty text for its fold; texts are read whole; other columns, whatever their names, are left out; an empty table gives an
    empty result.
    """
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_quality(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
