"""Operator 4: convolutional toxicity classifier, trained in numpy.

Words are hashed into an embedding table of 2 ** 20 buckets, of which only those
that LEAST_DOCS training documents share have rows (the others share one); filters of several widths slide over
them, each filter's largest response is kept (max pooling) and a logistic layer
reads these.  One embedding dimension starts as the bucket's smoothed log odds
among these documents; all of it is trained.  A worker makes, for
each width and place in the filter, the table of embedding times filter, so that
scoring is look-ups, additions and a maximum.

All labelled documents outside the held-out fold are learned from, however many
and long they are: four fifths train, in shards of about SHARD documents
that start from the same parameters and whose changes are averaged; the others set the
thresholds, for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.llm.shared import Codes, hash64, materialize, per_process, prepare, remainder, split_words
from tokentally.llm.supervised import Sample, labelled_texts, sigmoid, with_scores

BUCKETS, DIM, WIDTHS, FILTERS, LEAST_DOCS = 1 << 20, 8, (1, 2, 3), 8, 3
LEAST_CALIBRATION = 40
#: Documents and words that one task trains on; parts of which one sets thresholds; logit steps that thresholds are chosen among, from -60 to 60.
SHARD, SHARD_WORDS, PARTS, STEPS = 4096, 4_000_000, 5, 1 << 14
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_PAD = max(WIDTHS) - 1
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def _code(word: str) -> int:
    """A bucket from 1; 0 is the padding."""
    return 1 + hash64(_ENDS.sub("", word).lower()) % (BUCKETS - 1)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' buckets, each document followed by padding, and where each document starts (plus the end)."""
    codes = per_process("toxicity codes", lambda: Codes(_code))
    words = [split_words(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 + _PAD for w in words])]).astype(np.int64)
    out = np.zeros(starts[-1], dtype=np.int64)
    flat = codes.of([x for w in words for x in w]).astype(np.int64)
    inside = np.ones(len(out), dtype=bool)
    for k in range(1 + _PAD):
        inside[starts[1:] - 1 - k] = False
    out[inside] = flat
    return out, starts


def _pooled_from(tables: list[list[np.ndarray]], idx: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Max over each document's windows; the windows that would reach into the next document are left out by ending a document's run at its first padding."""
    bounds = np.ravel(np.column_stack([starts[:-1], starts[1:] - _PAD]))
    pools = []
    n = len(idx) - _PAD
    for parts in tables:
        conv = parts[0][idx[:n]]
        for j in range(1, len(parts)):
            conv += parts[j][idx[j : n + j]]
        pools.append(np.maximum.reduceat(conv, np.minimum(bounds, n - 1), axis=0)[::2])
    return np.concatenate(pools, axis=1)


@dataclass
class ToxicityModel:
    rows: np.ndarray
    emb: np.ndarray
    filters: list[np.ndarray]
    hidden: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3
    trained: tuple[int, int] = (0, 0)  # documents of each label
    _tables: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}  # made where they are used

    @property
    def tables(self) -> list[list[np.ndarray]]:
        if self._tables is None:
            self._tables = [[self.emb @ f[j] for j in range(len(f))] for f in self.filters]
        return self._tables

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 of each text, over all its words."""
        return self._in_parts(texts, 1_000_000, buckets)

    def score_codes(self, codes: list[np.ndarray]) -> np.ndarray:
        """The same of texts as buckets() gives them."""
        return self._in_parts(codes, 200_000, lambda part: (np.concatenate(part), np.concatenate([[0], np.cumsum([len(c) for c in part])])))

    def _in_parts(self, items: list, most: int, laid) -> np.ndarray:
        scores = np.zeros(len(items))
        at = 0
        while at < len(items):  # parts of about so many characters or words bound the memory
            to, size = at, 0
            while to < len(items) and (to == at or size + len(items[to]) < most):
                size += len(items[to])
                to += 1
            idx, starts = laid(items[at:to])
            pooled = np.maximum(_pooled_from(self.tables, self.rows[idx], starts) + self.hidden, 0)
            scores[at:to] = sigmoid(pooled @ self.out + self.bias)
            at = to
        return scores


def gradients(docs: list[np.ndarray], y: np.ndarray, emb: np.ndarray, filters: list[np.ndarray], hidden: np.ndarray, out: np.ndarray, bias: float) -> tuple:
    """Mean log loss of some documents (rows of ``emb``, padding included), and its gradients: by filters, hidden, out, bias, and by the embedding's rows that the largest responses stand on (with their numbers before)."""
    g_f = [np.zeros_like(f) for f in filters]
    g_out, g_hidden, g_bias, loss = np.zeros_like(out), np.zeros_like(hidden), 0.0, 0.0
    rows_e, grads_e = [], []
    for idx, label in zip(docs, y, strict=True):
        x, n = emb[idx], len(idx) - _PAD
        peaks, tops = [], []
        for f in filters:
            conv = x[:n] @ f[0]
            for j in range(1, len(f)):
                conv += x[j : n + j] @ f[j]
            top = conv.argmax(axis=0)
            tops.append(top)
            peaks.append(conv[top, np.arange(FILTERS)])
        before = np.concatenate(peaks) + hidden
        pooled = np.maximum(before, 0)
        p = float(sigmoid(np.array(pooled @ out + bias)))
        loss -= np.log(max(p if label else 1 - p, 1e-300)) / len(docs)
        g = (p - label) / len(docs)
        g_out += g * pooled
        g_bias += g
        gp = g * out * (before > 0)
        g_hidden += gp
        for m, f in enumerate(filters):
            gm = gp[m * FILTERS : (m + 1) * FILTERS]
            for j in range(len(f)):
                at = tops[m] + j
                g_f[m][j] += x[at].T * gm
                rows_e.append(idx[at])
                grads_e.append(f[j].T * gm[:, None])
    uniq, back = np.unique(np.concatenate(rows_e), return_inverse=True)
    g_e = np.zeros((len(uniq), DIM))
    np.add.at(g_e, back, np.concatenate(grads_e))
    return loss, g_f, g_hidden, g_out, g_bias, uniq, g_e


@dataclass
class Parameters:
    """What is trained: embedding rows (0 the padding, 1 every bucket that too few documents share), filters, and the logistic layer."""

    emb: np.ndarray
    filters: list[np.ndarray]
    hidden: np.ndarray
    out: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        """All but the embedding, in one row."""
        return np.concatenate([*[f.ravel() for f in self.filters], self.hidden, self.out, [self.bias]])

    def with_changes(self, emb: np.ndarray, dense: np.ndarray) -> Parameters:
        ends = np.cumsum([*[f.size for f in self.filters], self.hidden.size, self.out.size])
        *filters, hidden, out, bias = np.split(self.dense() + dense, ends)
        return Parameters(self.emb + emb, [x.reshape(f.shape) for x, f in zip(filters, self.filters, strict=True)], hidden, out, float(bias[0]))


def start(seen: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> Parameters:
    """First parameters, from how many documents of each label hold each known bucket, and how many documents each label has."""
    seen, share = np.concatenate([np.zeros((2, 2)), seen], axis=1), np.maximum(share, 1).astype(float)
    # Rare buckets start near zero, so that a long text's many rare words can't win the maximum by chance.
    prior = 10 * share / share.sum()
    emb = rng.normal(0, 0.1, (seen.shape[1], DIM)) * (seen.sum(axis=0) / (seen.sum(axis=0) + 10))[:, None]
    emb[:, 0] = (np.log((seen[1] + prior[1]) / share[1]) - np.log((seen[0] + prior[0]) / share[0])) / 3
    emb[:2] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 1.0
    n = FILTERS * len(WIDTHS)
    return Parameters(emb, filters, np.full(n, -0.3), rng.normal(0.2, 0.1, n), -1.0)


def known_rows(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that LEAST_DOCS documents share, and each bucket's row."""
    known = np.flatnonzero(seen.sum(axis=0) >= LEAST_DOCS)
    known = known[known > 0]
    rows_of = np.ones(BUCKETS, dtype=np.int32)
    rows_of[0], rows_of[known] = 0, np.arange(2, 2 + len(known))
    return known, rows_of


def train(p: Parameters, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int = 6, batch: int = 32, rate: float = 0.02) -> None:
    """Adagrad over minibatches of documents (rows of the embedding); changes ``p``."""
    emb, filters, hidden, out = p.emb, p.filters, p.hidden, p.out
    grown = [np.zeros_like(emb), *[np.zeros_like(f) for f in filters], np.zeros_like(hidden), np.zeros_like(out)]
    grown_bias = 0.0

    def step(p: np.ndarray, g: np.ndarray, acc: np.ndarray, at=...) -> None:
        acc[at] += g * g
        p[at] -= rate * g / (np.sqrt(acc[at]) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            _, g_f, g_hidden, g_out, g_bias, uniq, g_e = gradients([docs[k] for k in part], y[part], emb, filters, hidden, out, p.bias)
            g_e[uniq < 2] = 0
            step(emb, g_e, grown[0], uniq)
            for m, f in enumerate(filters):
                step(f, g_f[m], grown[1 + m])
            step(out, g_out, grown[-1])
            step(hidden, g_hidden, grown[-2])
            grown_bias += g_bias * g_bias
            p.bias -= rate * g_bias / (np.sqrt(grown_bias) + 1e-6)


def _model(rows_of: np.ndarray, p: Parameters, shift: float = 0.0) -> ToxicityModel:
    return ToxicityModel(rows_of, p.emb.astype(np.float32), [f.astype(np.float32) for f in p.filters], p.hidden.astype(np.float32), p.out.astype(np.float32), float(p.bias) + shift)


def fit(sample: Sample, epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 5) -> ToxicityModel:
    """The training on one machine, of documents at hand; the query's is train_toxicity().  Every fifth document sets the languages' thresholds instead.

    A sample may hold both labels about evenly where the corpus doesn't: for the
    thresholds each document weighs as many as it stands for (sample.totals).
    Languages with fewer than LEAST_CALIBRATION documents, or fewer than five of a
    label, take the threshold of all.
    """
    rng = np.random.default_rng(seed)
    y = sample.labels.astype(np.float64)
    docs = []
    for i in range(0, len(sample.texts), 256):
        idx, starts = buckets(sample.texts[i : i + 256])
        docs += [idx[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    rows = np.arange(len(docs))
    own, calibrate = rows[rows % PARTS != 0], rows[rows % PARTS == 0]
    seen = np.zeros((2, BUCKETS))
    for k in own:
        seen[int(y[k]), np.unique(docs[k])] += 1
    known, rows_of = known_rows(seen)
    p = start(seen[:, known], np.array([(y[own] == v).sum() for v in (0, 1)]), rng)
    train(p, [rows_of[docs[k]] for k in own], y[own], rng, epochs, batch, rate)
    model = _model(rows_of, p, sample.shift())
    scores = model.score([sample.texts[k] for k in calibrate])
    told, weight = y[calibrate], sample.weights()
    model.threshold = _threshold(scores, told, weight)
    for lang in sorted({sample.langs[k] for k in calibrate}):
        own = np.array([sample.langs[k] == lang for k in calibrate])
        if _enough(int(own.sum()), int(told[own].sum())):
            model.thresholds[lang] = _threshold(scores[own], told[own], weight)
    return model


def _enough(n: int, ones: int) -> bool:
    return n >= LEAST_CALIBRATION and min(ones, n - ones) >= 5


def _threshold(scores: np.ndarray, y: np.ndarray, weight: tuple[float, float] = (1.0, 1.0)) -> float:
    """The score with the best F1 of weighted documents, in the middle of the gap below it; the fixed threshold where one label is missing."""
    order = np.argsort(-scores, kind="stable")
    return _cut(y[order] * weight[1], (1 - y[order]) * weight[0], scores[order], scores[order])


def _cut(ones: np.ndarray, zeros: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """_threshold() of groups of documents with falling scores: their weight by label, their smallest and largest score."""
    if not ones.any() or not zeros.any():
        return THRESHOLD
    right, wrong = np.cumsum(ones), np.cumsum(zeros)
    f1 = 2 * right / (right + wrong + ones.sum())
    k = int(f1.argmax())
    below = high[k + 1] if k + 1 < len(ones) else 0.0
    return float((low[k] + below) / 2)


def coded(texts: DataFrame) -> DataFrame:
    """doc_id, label, lang, calibrates, codes (buckets() in 32 bits, padding included) of labelled_texts(), written once: every pass reads these."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(PARTS)) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, starts = buckets(batch.column(4).to_pylist())
            idx = idx.astype(np.int32)
            codes = pa.array([idx[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], codes], names=["doc_id", "label", "lang", "calibrates", "codes"])

    return materialize(texts.select("doc_id", "label", "lang", fold.alias("calibrates"), "text").mapInArrow(run, "doc_id long, label int, lang string, calibrates boolean, codes binary"), "codes")


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in column]


def document_counts(codes: DataFrame) -> DataFrame:
    """code, zeros, ones: how many of the documents of each label hold a bucket.  Tasks hand on sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for label, own in zip(batch.column(0).to_pylist(), _codes(batch.column(1)), strict=True):
                seen[label, np.unique(own)] += 1
        held = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(held), 100_000):
            at = held[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["code", "zeros", "ones"])

    return codes.select("label", "codes").mapInArrow(run, "code int, zeros long, ones long").groupBy("code").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


_BLOCK = [f"d{k}" for k in range(DIM)]


def shard_changes(codes: DataFrame, shard: Column, shared, seed: int) -> DataFrame:
    """row, d0 to d7, shards: each parameter's change, averaged over the shards that changed it.  Rows from 0 are the embedding's, row -1 - k is the k-th block of the others.

    A shard takes the same documents in the same order wherever it runs.  Changes are rounded
    to 32 bits, so that sums in 64 bits don't depend on their order as long as the changes of a parameter are within a factor of
    2 ** 29 of each other; beyond that the last bits may differ.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows_of, p = shared.value
        t = t.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        docs = [rows_of[c] for chunk in t.column("codes").chunks for c in _codes(chunk)]
        own = np.unique(np.concatenate([[0, 1], *docs]))  # a shard's tables have its own rows only
        mine = Parameters(p.emb[own].astype(np.float64), [f.copy() for f in p.filters], p.hidden.copy(), p.out.copy(), p.bias)
        train(mine, [np.searchsorted(own, d) for d in docs], t.column("label").to_numpy().astype(np.float64), np.random.default_rng([seed, key[0].as_py()]))
        moved = (mine.emb - p.emb[own]).astype(np.float32)
        on = moved.any(axis=1)
        dense = (mine.dense() - p.dense()).astype(np.float32)
        dense = np.pad(dense, (0, -len(dense) % DIM)).reshape(-1, DIM)
        block = np.concatenate([moved[on], dense]).astype(np.float64)
        rows = np.concatenate([own[on], -1 - np.arange(len(dense))]).astype(np.int32)
        return pa.table([pa.array(rows), *[pa.array(block[:, k]) for k in range(DIM)]], names=["row", *_BLOCK])

    laid = codes.select(shard.alias("shard"), F.xxhash64("doc_id", F.lit(7)).alias("place"), "doc_id", "label", "codes")
    changes = laid.groupBy("shard").applyInArrow(run, "row int, " + ", ".join(f"{c} double" for c in _BLOCK))
    return changes.groupBy("row").agg(*[F.avg(c).alias(c) for c in _BLOCK])


def calibration(codes: DataFrame, shared) -> DataFrame:
    """lang, step, ones, zeros, low, high: the documents' scores, summed up in steps of the logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score_codes(_codes(batch.column(2)))
            logit = np.log(scores) - np.log1p(-np.minimum(scores, 1 - 1e-16))
            step = np.floor((np.clip(logit, -60, 60) + 60) / 120 * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(step), pa.array(scores)], names=["lang", "label", "step", "score"])

    scored = codes.select("lang", "label", "codes").mapInArrow(run, "lang string, label int, step int, score double")
    return scored.groupBy("lang", "step").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"), F.min("score").alias("low"), F.max("score").alias("high"))


def _cut_of(steps: DataFrame) -> float:
    t = steps.groupBy("step").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by([("step", "descending")])
    return _cut(*[t.column(c).to_numpy() for c in ("ones", "zeros", "low", "high")])


def cuts_by_language(steps: DataFrame) -> DataFrame:
    """lang, threshold of the languages with documents enough, from the scores' steps: STEPS rows a language at most, all languages in one job."""

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by([("step", "descending")])
        ones, zeros, low, high = (t.column(c).to_numpy() for c in ("ones", "zeros", "low", "high"))
        own = _enough(int(ones.sum() + zeros.sum()), int(ones.sum()))
        return pa.table([t.column("lang").slice(0, int(own)), pa.array([_cut(ones, zeros, low, high)] * own, pa.float64())], names=["lang", "threshold"])

    return steps.groupBy("lang").applyInArrow(cut, "lang string, threshold double")


def train_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 5) -> ToxicityModel:
    """The model of learn(), whose threshold is that of all languages."""
    return learn(docs, labels, seed)[0]


def learn(docs: DataFrame, labels: DataFrame, seed: int = 5) -> tuple[ToxicityModel, DataFrame]:
    """A model, and lang, threshold of the languages that have one of their own.

    Learns from all labelled rows outside the held-out fold (labelled_texts()); lang only groups the thresholds.  Without labels, scores are those of an untrained model.

    The driver sees sums for each bucket, parameter and step of the scores, whose number is
    fixed, and none of the texts.  Languages with fewer than LEAST_CALIBRATION documents
    among those that set thresholds, or fewer than five of a label, take the threshold of all.
    """
    spark = docs.sparkSession
    prepare(spark)
    codes = coded(labelled_texts(docs, labels, "toxic", FOLDS, HELD_OUT))
    own, rest = codes.where("NOT calibrates"), codes.where("calibrates")
    counted = own.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("codes")).alias("size")).collect()
    share = np.array([sum(r.n for r in counted if r.label == v) for v in (0, 1)])
    t = document_counts(own).where(F.col("zeros") + F.col("ones") >= LEAST_DOCS).toArrow()
    seen = np.zeros((2, BUCKETS))
    for k, c in enumerate(("zeros", "ones")):
        seen[k, t.column("code").to_numpy()] = t.column(c).to_numpy()
    known, rows_of = known_rows(seen)
    p = start(seen[:, known], share, np.random.default_rng(seed))
    p.emb = p.emb.astype(np.float32)
    del seen, t
    if share.any():
        shards = max(1, -(-int(share.sum()) // SHARD), -(-sum(r.size for r in counted) // (4 * SHARD_WORDS)))
        shared = spark.sparkContext.broadcast((rows_of, p))
        t = shard_changes(own, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int"), shared, seed).toArrow()
        shared.destroy()
        rows, block = t.column("row").to_numpy(), np.column_stack([t.column(c).to_numpy() for c in _BLOCK])
        emb, dense = np.zeros(p.emb.shape, dtype=np.float32), np.zeros((-(-len(p.dense()) // DIM), DIM))
        emb[rows[rows >= 0]], dense[-1 - rows[rows < 0]] = block[rows >= 0], block[rows < 0]
        p = p.with_changes(emb, dense.ravel()[: len(p.dense())])
    model = _model(rows_of, p)
    model.trained = (int(share[0]), int(share[1]))
    shared = spark.sparkContext.broadcast(model)
    steps = materialize(calibration(rest, shared), "steps")
    shared.destroy()
    model.threshold = _cut_of(steps)
    return model, materialize(cuts_by_language(steps), "cuts")


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without text, plus ``score``; null and empty texts and repeated rows are scored like others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_scores(docs, lambda texts: shared.value.score(texts))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged by the language's threshold (lang_threshold).

    Null, empty and very long texts, repeated rows and rows without doc_id or language are scored
    like others; a language without a threshold of its own takes that of all; where the
    labels have one value only, or none, thresholds are 0.3.  Further columns are ignored.
    """
    model, cuts = learn(docs, labels)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text"), model)
    scored = scored.join(cuts, "lang", "left")
    limit = F.coalesce("threshold", F.lit(model.threshold))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"))
