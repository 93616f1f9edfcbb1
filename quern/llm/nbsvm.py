"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of hashed n-grams: byte trigrams of the text, and one-
to three-grams of word shapes (case, digits, marks, and whether a word repeats
the one before). For each feature the number of training texts of either class
that have it gives the log-count ratio ``r``; these counts are grouped sums over
all labelled training rows, at most ``DIM`` of them. A text's vector is
``r`` at its features, scaled to length one. A linear-hinge-loss model is fitted
by dual coordinate descent on a bounded sample of labelled rows: the
``max_rows`` (20,000) with the smallest hashed ids, ties by label and features. A fifth of the sample is kept
from the fit and turns margins into probabilities (a sigmoid with two
parameters).

Scores use the text only. Defined results: null and empty texts have no feature
and get the score of margin 0. Very long texts are read whole. An empty table has
no scores. Labels other than 0 and 1 are left out. Without
rows of both classes every score is the smoothed share of class 1. A document
with several labels counts with each. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Memo, crc_mod, documents, held, row_type, slices, text_bytes, written

BITS = 18
DIM = 1 << BITS
MAX_ROWS = 20_000


def _shape(word: bytes) -> int:
    """Case, digits, first and last mark, and length class of a word."""
    t = word.decode("utf-8", "replace")
    core = t.strip("!?.,;:|*#$%&()[]{}\"'-_=+/\\<>~^@")
    case = 0 if not core else 1 if core.isupper() and len(core) > 1 else 2 if core[0].isupper() else 3 if core.islower() else 4
    digit = 2 if core.isdigit() else int(any(c.isdigit() for c in core))
    tail = t[-1] if core and not t[-1].isalnum() else ""
    marks = len(t) - len(core)
    size = min(len(core), 40) // 8
    return hash((case, digit, ord(tail) if tail else 0, min(marks, 4), size)) & 0x7FFFFFFF


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    parts = []
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    if len(b) > 2:
        parts.append(np.unique(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]))
    words = text.split()
    if words:
        known = held("word-shapes", lambda: Memo(200_000))
        shapes = []
        for w in words:
            s = known.get(w)
            if s is None:
                s = _shape(w)
                if len(w) <= known.KEY:
                    known.make_room(1)
                    known[w] = s
            shapes.append(s)
        s = np.array(shapes, dtype=np.uint64) << np.uint64(1)
        s[1:] |= np.array([x == y for x, y in zip(words, words[1:])], dtype=np.uint64)
        with np.errstate(over="ignore"):
            two = s[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[1:]
            three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[2:]
            for k, grams in enumerate((s, two, three)):
                parts.append(np.unique(grams) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((k + 1) << 40))
    with np.errstate(over="ignore"):
        h = np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15) if parts else np.zeros(0, dtype=np.uint64)
    return np.unique(h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """``weight`` already holds the log-count ratios; ``slope`` and ``shift`` make probabilities of margins."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, f: np.ndarray) -> float:
        if not len(f):
            return 0.0
        r = self.ratio[f]
        norm = float(np.sqrt((r * r).sum()))
        return float((r * self.weight[f]).sum()) / norm + self.bias if norm else self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -500, 500))))


def class_counts(rows: DataFrame) -> np.ndarray:
    """Texts with each feature, by class (2 x DIM), and of ``text, y`` rows of any number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, DIM), dtype=np.int64)
        for batch in slices(batches, "text"):
            for raw, y in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist()):
                count[y, features(raw)] += 1
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], ["feature", "n0", "n1"])

    out = np.zeros((2, DIM), dtype=np.int64)
    sums = rows.select("text", "y").mapInArrow(run, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most DIM rows
    for k, name in enumerate(("n0", "n1")):
        out[k, sums.column("feature").to_numpy()] = sums.column(name).to_numpy()
    return out


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = 40, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised linear-hinge SVM; rows are (features, values).

    Each dual variable stays in ``[0, cost]``. The bias is the weight of a
    feature that all rows have. It ends when no projected gradient of a whole
    pass is beyond ``tolerance``, or after ``epochs``.
    """
    w, bias = np.zeros(DIM), 0.0
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    square = np.array([float((v * v).sum()) + 1.0 for _, v in rows])
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, bias


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with targets smoothed as for few rows of a class."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - t))
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(labelled: DataFrame, text: str = "text", label: str = "y", key: str = "key", max_rows: int = MAX_ROWS, c: float = 1.0) -> Model:
    """Counts over all rows, weights from the ``max_rows`` rows with the smallest hashed keys."""
    rows = written(labelled.filter(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("h")), "nbsvm-rows")
    count = class_counts(rows)
    total = count.sum(axis=1)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(np.zeros(DIM), np.zeros(DIM), shift=float(np.log(share / (1 - share))))
    ratio = np.log((count[1] + 1) / (total[1] + DIM)) - np.log((count[0] + 1) / (total[0] + DIM))
    ratio[count.sum(axis=0) == 0] = 0.0
    last = rows.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            f = [features(t).astype("<i4").tobytes() for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(f, pa.binary())], ["h", "y", "f"])

    # One job; repeated ids tie at the last hash, so the limit holds here, too.
    taken = rows.filter(F.col("h") <= last).mapInArrow(run, "h long, y int, f binary").orderBy("h", "y", "f").limit(max_rows).toArrow()
    sample = [(h, label, np.frombuffer(f, dtype="<i4")) for h, label, f in zip(*(taken.column(c).to_pylist() for c in ("h", "y", "f")))]
    y = np.where(np.array([r[1] for r in sample]) == 1, 1.0, -1.0)
    scaled = []
    for _, _, f in sample:
        v = ratio[f]
        scaled.append((f, (v / max(float(np.sqrt((v * v).sum())), 1e-9)).astype(np.float32)))
    held = np.arange(len(sample)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    share = np.array([(y[train] > 0).mean(), (y[train] < 0).mean()])
    cost = c * np.where(y[train] > 0, 0.5 / max(share[0], 1e-9), 0.5 / max(share[1], 1e-9))
    w, bias = dual_coordinate_descent([scaled[i] for i in train], y[train], cost)
    check = np.flatnonzero(held) if held.any() else train
    margin = np.array([float(w[scaled[i][0]] @ scaled[i][1]) + bias for i in check])
    slope, shift = _sigmoid_fit(margin, y[check])
    return Model(ratio.astype(np.float32), w.astype(np.float32), bias, slope, shift)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score``. The broadcast is two vectors of DIM floats."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))
    kind = row_type({"kept": rows.schema["kept"].dataType}, "score double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([m.score(features(t)) for t in text_bytes(batch.column("text"))], pa.float64())], ["kept", "score"])

    return rows.mapInArrow(run, kind).select("kept.*", "score")


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``key, text, y`` of labelled rows that are not held out; those are taken away before the join."""
    left = docs.filter(~held_out).select(F.col("doc_id").alias("key"), "text")
    right = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("key"), F.col("quality").alias("y"))
    # A merge join at every size: texts are shuffled once, in proportion to the input, and labels never have to fit in memory.
    return left.join(right.hint("merge"), "key")


def op8_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_mod("doc_id", 4) == 2
    model = fit(training_rows(docs, documents(spark, sf_dir, "labels"), held))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
