"""Quality classifier: naive Bayes support vectors (operator 3).

Features are indicators of n-grams: words and word pairs, and one to three word shapes in a row (a shape
keeps the kinds of characters without repeats, and whether the word repeats the one before it), hashed
into 2 ** 18 buckets. Each indicator is scaled by the log ratio of its smoothed counts in the two
classes; a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent; a
logistic curve, fitted to margins of rows that the model was not fitted to, turns margins into scores.

The model is fitted on the driver to at most FIT_ROWS labelled rows, those whose ids have the smallest hashes (the
bound on what reaches the driver, as their indicators). Scoring reads every whole text, in Arrow batches, without a shuffle.

Defined cases: an id with several labels has the highest; of rows that repeat a labelled id, the text with the smallest hash is
learned from; long texts are worked on in pieces; null and empty texts get the score of no indicators; null ids are never learned from and
count as not held out; repeated rows are scored each by itself; without labels of both classes
every score is the share of label 1 (0.5 if there are no labels); an empty table gives an empty result;
other columns (language and source among them) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .text_hash import U, mix, pieces, word_hashes

BUCKETS = 1 << 18
FIT_ROWS = 12_000
THRESHOLD = 0.3

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = ord("1")
_KIND[97:123] = ord("2")
_KIND[128:] = ord("2")
_KIND[48:58] = ord("3")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct indicators of each row, in order."""
    words, first = word_hashes(data, offsets)
    kind = _KIND[data]
    fresh = np.ones(len(kind), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(kind)]] = True
    shapes, _ = word_hashes(kind[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same_row = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.empty(0, bool)
    repeat = np.concatenate([[False], words[1:] == words[:-1]]) & same_row if len(row) else np.empty(0, bool)
    shape = mix(shapes + repeat.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    rows, grams = [row, row], [mix(words + U(1)), mix(shape + U(2))]
    for tokens, most, salt in ((words, 2, 3), (shape, 3, 5)):
        gram = tokens
        for n in range(2, most + 1):
            if len(tokens) < n:
                break
            gram = mix(gram[:-1] * U(0xC2B2AE3D27D4EB4F) + tokens[n - 1 :] + U(salt + n))
            inside = row[n - 1 :] == row[: len(row) - n + 1]
            rows.append(row[n - 1 :][inside])
            grams.append(gram[inside])
    keys = np.concatenate(rows).astype(np.uint64) * U(BUCKETS) + (np.concatenate(grams) & U(BUCKETS - 1))
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys // U(BUCKETS)).astype(np.int64), (keys % U(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # by bucket, log-count ratios included
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = features(data, offsets)
        margin = np.bincount(row, self.weights[bucket], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_ratios(indices: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / sum p) / (q / sum q)) of the smoothed indicator counts p, q of the classes 1 and -1."""
    counts = [np.bincount(np.concatenate([x for x, v in zip(indices, y, strict=True) if v == side]), minlength=BUCKETS) + smooth for side in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(indices: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (in the space of the scaled indicators) and bias that minimise |w|^2 / 2 + c * sum(hinge)."""
    norms = [1.0 / max(np.sqrt((r[x] ** 2).sum()), 1e-12) for x in indices]  # rows of unit length
    values = [r[x] * s for x, s in zip(indices, norms, strict=True)]
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = indices[i], values[i]
            gradient = y[i] * (v @ w[x] + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), c)
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[x] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the largest likelihood, with targets smoothed by the class sizes."""
    pos, neg = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -500, 500)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (target - p))
        theta = theta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(indices: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from the indicator indices and the labels (0, 1) of rows."""
    y = np.where(np.asarray(labels) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        share = float((y == 1).mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    own = np.arange(len(y)) % 5 != 0
    if len(set(y[own].tolist())) < 2 or len(set(y[~own].tolist())) < 2:
        own = np.ones(len(y), dtype=bool)
    part = [x for x, k in zip(indices, own, strict=True) if k]
    r = log_ratios(part, y[own])
    w, bias = dual_coordinate_descent(part, y[own], r)
    # The margin of a row of any length is taken over its unit-length indicators' typical scale.
    scale = float(np.median([1.0 / max(np.sqrt((r[x] ** 2).sum()), 1e-12) for x in part]))
    weights = w * r * scale
    rest = [x for x, k in zip(indices, ~own if not own.all() else own, strict=True) if k]
    margins = np.array([weights[x].sum() + bias for x in rest])
    return Model(weights, bias, *calibrate(margins, y[~own] if not own.all() else y))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column(2)):
            row, bucket = features(data, offsets)
            ends = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))], ["id", "label", "idx"])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.mapInArrow(_indexed, "id long, label int, idx array<int>").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    lists = got.column("idx").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return fit([flat[ends[i] : ends[i + 1]] for i in order], got.column("label").to_numpy()[order])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(data, offsets), pa.float64())], ["id", "score"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    model.weights = model.weights.astype(np.float32)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scorer(model), "id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
