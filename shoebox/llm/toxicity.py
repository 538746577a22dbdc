"""Toxicity: a factorization machine over hashed terms (operator 11).

Terms are runs of letters and digits of the lower-cased text, and the first four to seven bytes of longer runs (stems);
each is hashed into 2 ** 40 values, so that unrelated terms practically never share one. A text is the set x of its terms:

    margin(x) = w0 + sum_i w_i + sum_{i<j} <v_i, v_j> / n        for the n terms i, j of x with factors

The factors v learn what additive weights cannot: two terms that count only together (an insult with a group mention), or
that cancel each other. The pair sum takes one pass, as half of (sum v)^2 - sum v^2 in each factor. Weights are fitted
by adaptive gradient steps on logistic loss; a proximal step after each sends weights and whole factor rows that
do not pay to zero, so only terms that matter are kept and a long clean text does not gather noise. A logistic curve
fitted to rows that the weights were not fitted to turns margins into scores.

The model is fitted on the driver to at most FIT_ROWS labelled rows of each class, those whose ids have the smallest hashes:
that is the bound on what reaches the driver, as at most TERMS hashes a row (those with the smallest hashes of a longer row;
the bound holds for fitted rows only). Scores stand for the balance of classes among the fitted rows. Scoring
reads every whole text, in Arrow batches, without a shuffle; the model (the terms kept) is shipped to the tasks.

Defined cases: an id with several labels has the highest; of rows that repeat a labelled id, the text with the smallest hash is
learned from; null and empty texts get the score of no terms; very long texts are worked on whole; null ids are never learned from and
count as not held out; repeated rows are scored each by itself; without labels of both classes every score is the
share of label 1 (0.5 if there are no labels); an empty table gives an empty result; other columns (language and source
among them) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_classifier import calibrate
from .text_hash import U, mix, pieces, word_hashes

FIT_ROWS = 3_000
TERMS = 8_192
RANK = 4
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7)
_BITS = U(40)

_PART = np.zeros(256, dtype=bool)  # bytes of letters and digits
_PART[48:58] = _PART[97:123] = _PART[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the rows, hashes): the distinct terms of each row, in order."""
    part = _PART[data]
    clean = np.where(part, data, np.uint8(32))
    at = np.arange(len(data))
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = at - np.maximum.accumulate(np.where(begins | ~part, at, 0)) if len(data) else at
    hashes, rows = [], []

    def add(bytes_: np.ndarray, edges: np.ndarray, salt: int) -> None:
        own, first = word_hashes(bytes_, edges)
        hashes.append(mix(own + U(salt)) >> (U(64) - _BITS))
        rows.append(np.repeat(np.arange(len(edges) - 1), np.diff(first)))

    add(clean, offsets, 1)
    for k in STEMS:
        # A separator stays; of a run, its first k bytes stay if it goes on beyond them, else none.
        longer = np.flatnonzero(part & (place == k))
        keep = ~part
        for j in range(k):
            keep[longer - k + j] = True
        edges = np.concatenate([[0], np.cumsum(keep)])[offsets]
        add(clean[keep], edges, k * 0x9E3779B9)
    row, term = np.concatenate(rows).astype(np.int64), np.concatenate(hashes)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    row, term = row[new], term[new]
    return np.searchsorted(row, np.arange(len(offsets))), term


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values between ends, 0 for empty rows."""
    total = np.zeros((len(ends) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        total[full] = np.add.reduceat(values, ends[:-1][full], axis=0, dtype=np.float64)
    return total


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the terms kept
    weights: np.ndarray
    factors: np.ndarray  # a row per term
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, ends: np.ndarray, term: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        if not len(self.keys):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1)
        hit = self.keys[at] == term
        own, inner = at[hit], np.concatenate([[0], np.cumsum(hit)])[ends]
        v = self.factors[own]
        pairs = 0.5 * (_sums(v, inner) ** 2 - _sums(v * v, inner)).sum(axis=1)
        return self.bias + _sums(self.weights[own], inner) + pairs / np.maximum(_sums((v != 0).any(axis=1), inner), 1)

    def score(self, ends: np.ndarray, term: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ends, term) + self.shift, -500, 500)))


def factorization_machine(
    rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = 12, batch: int = 32, rate: float = 0.15, lasso: float = 0.003, pair_rate: float = 0.1, pair_lasso: float = 3e-4, spread: float = 0.3, first: float = 1e-6, least: int = 3, seed: int = 11,
) -> Model:
    """A machine fitted to rows (sorted distinct terms) and labels (0, 1); only terms of at least `least` rows are looked at."""
    every, counts = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_counts=True)
    keys = every[counts >= least]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(keys)), rng.normal(0, spread, (len(keys), rank)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gv = np.full(len(keys), 1e-2), np.full((len(keys), 1), first)  # one adaptive rate per factor row: it is kept or dropped whole
    local = []
    for x in rows:
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        local.append(at[keys[at] == x] if len(keys) else at[:0])
    plan = []
    order = rng.permutation(len(rows))
    for a in range(0, len(rows), batch):
        own = order[a : a + batch]
        flat = np.concatenate([local[i] for i in own])
        ends = np.concatenate([[0], np.cumsum([len(local[i]) for i in own])])
        by_term = np.argsort(flat, kind="stable")
        touched, starts = np.unique(flat[by_term], return_index=True)
        plan.append((own, flat, ends, np.repeat(np.arange(len(own)), np.diff(ends)), by_term, touched, starts))
    for _ in range(epochs):
        for b in rng.permutation(len(plan)):
            own, flat, ends, row, by_term, touched, starts = plan[b]
            if not len(touched):
                continue
            vf = v[flat]
            s, n = _sums(vf, ends), np.maximum(_sums((vf != 0).any(axis=1), ends), 1)
            margin = bias + _sums(w[flat], ends) + 0.5 * (s * s - _sums(vf * vf, ends)).sum(axis=1) / n
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
            bias -= rate * error.sum()
            dw = np.add.reduceat(error[row][by_term], starts)
            dv = np.add.reduceat(((error / n)[row][:, None] * (s[row] - vf))[by_term], starts, axis=0)
            gw[touched] += dw * dw
            gv[touched] += (dv * dv).sum(axis=1, keepdims=True) / max(rank, 1)
            step = rate / np.sqrt(gw[touched])
            new = w[touched] - step * dw
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
            step = pair_rate / np.sqrt(gv[touched])
            new = v[touched] - step * dv
            size = np.sqrt((new * new).sum(axis=1, keepdims=True))
            v[touched] = new * np.maximum(1 - step * pair_lasso / np.maximum(size, 1e-12), 0)
    kept = (w != 0) | (v != 0).any(axis=1)
    return Model(keys[kept], w[kept], v[kept], bias)


def fit(rows: list[np.ndarray], labels: np.ndarray, **parameters) -> Model:
    """A calibrated model of rows (sorted distinct terms) and labels (0, 1)."""
    y = np.asarray(labels, dtype=float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.empty(0, np.uint64), np.empty(0), np.empty((0, RANK)), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    own = np.arange(len(y)) % 5 != 0
    if len(set(y[own].tolist())) < 2 or len(set(y[~own].tolist())) < 2:
        own = np.ones(len(y), dtype=bool)
    model = factorization_machine([x for x, k in zip(rows, own, strict=True) if k], y[own], **parameters)
    rest = [x for x, k in zip(rows, own, strict=True) if own.all() or not k]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rest])])
    model.slope, model.shift = calibrate(model.margins(ends, np.concatenate(rest)), np.where(y if own.all() else y[~own], 1, -1))
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _gathered(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(pc.utf8_lower(batch.column(2))):
                ends, term = terms(data, offsets)
                own = [term[x:y] if y - x <= most else np.sort(term[x:y][np.argpartition(mix(term[x:y]), most)[:most]]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*own, np.empty(0, np.uint64)]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["id", "label", "terms"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, most_terms: int = TERMS, **parameters) -> Model:
    """A model of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    first = [known.where(F.col("label") == v).orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_rows) for v in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.mapInArrow(_gathered(most_terms), "id long, label int, terms array<long>").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    lists = got.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.uint64)
    return fit([flat[ends[i] : ends[i + 1]] for i in order], got.column("label").to_numpy()[order], **parameters)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(pc.utf8_lower(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(*terms(data, offsets)), pa.float64())], ["id", "score"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scorer(model), "id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
