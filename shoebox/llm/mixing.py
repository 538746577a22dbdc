"""Mixing sources to target weights by entropy balancing (operator 10).

The mix takes each document at a rate. Rates stay as near to 1 as the token constraints allow, in
Kullback-Leibler divergence over tokens: minimise sum(size * (r log r - r + 1)) subject to, for every
level of every margin, sum(size * r) = target. The dual is convex and the rates are exponential
tilts, r = exp(sum of the multipliers of the document's levels). `balance` solves the dual by Newton
steps: Spark sums the tilted tokens and their Hessian over pre-aggregated cells, the driver solves a
system with one row per level. `thresholds` rounds the rates into whole copies.

Rounding: a document gets floor(r) copies, and one more where its hash bin (of id and text) is under a threshold.
Documents fall into classes by size (powers of two). From the largest class to the smallest,
each takes the fraction of its tokens that the target still lacks, and passes what it could not
meet on to the next; in the end single bins are added or taken away as long as that brings the source nearer to its target.
Only sums by (source, class, bin) leave the tasks: at most 41 x BINS rows per source, whatever the input.

Defined cases: null and empty texts have size 0 and take 0; null sources are one source, last in
order; null ids are kept; rows of one id but different texts are rounded apart; rows equal in id and text are rounded together
unless a bin of PART_ROWS or more of them outweighs PART_SHARE of its source, which is then split evenly among its rows (reruns agree, however
the input is split into tasks: of n equal rows the same number is taken); very long texts only count their words; an empty table gives an empty mix. Other columns pass through `mixed` unread (names that
begin with __mix are reserved). The number of levels of all margins is checked against `max_levels`, since the driver
holds them; margins that cannot be met raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, table, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BINS = 1024
#: Rows and share of a source from which on a bin of equal rows is split.
PART_ROWS, PART_SHARE = 32, 0.002
#: Bins of a source that are added or taken away at most to come nearer to its target.
FLIPS = 16
#: Bins of a source up to which all choices of them are tried.
ALL_CHOICES = 16


def _class(size: Column) -> Column:
    return F.length(F.bin(size)).cast("int")


def _bin(doc_id: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, text, F.lit("mix")), F.lit(BINS)).cast("int")


def water_fill(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight; what is over cap x size is shared anew among the others."""
    total, out, active = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = total
    while active:
        unit = left / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        active = [i for i in active if out[i] == 0.0]
    return out


def balance(cells: DataFrame, targets: dict[str, dict], tokens: str = "tokens", tolerance: float = 1e-10, max_steps: int = 60) -> dict[str, dict]:
    """Multipliers by margin column and level, such that the tilted tokens of each level meet its target.

    cells: one row per combination of levels, with its tokens. targets: by margin column, by level
    (null as None). Levels with a target or tokens of zero get no multiplier (0.0).
    """
    spark, margins = cells.sparkSession, list(targets)
    totals = {m: {r[0]: float(r[1] or 0) for r in cells.groupBy(m).agg(F.sum(tokens)).collect()} for m in margins}
    index = [(m, level) for m in margins for level, t in targets[m].items() if t > 0 and totals[m].get(level, 0) > 0]
    where, goal = {x: i for i, x in enumerate(index)}, np.array([float(targets[m][level]) for m, level in index])
    lam = np.zeros(len(index))
    if not index:
        return {m: dict.fromkeys(targets[m], 0.0) for m in margins}

    def summed(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = cells
        for k, m in enumerate(margins):
            levels = spark.createDataFrame([(level, where[m, level], float(lam[where[m, level]])) for x, level in index if x == m], f"__l{k} {dict(cells.dtypes)[m]}, __i{k} int, __m{k} double")
            out = out.join(levels, F.col(m).eqNullSafe(F.col(f"__l{k}")), "left")
        tilt = sum((F.coalesce(F.col(f"__m{k}"), F.lit(0.0)) for k in range(len(margins))), F.lit(0.0))
        out = out.withColumn("__t", F.col(tokens) * F.exp(tilt))
        pairs = F.array(*[F.struct(F.col(f"__i{a}").alias("a"), F.col(f"__i{b}").alias("b")) for a in range(len(margins)) for b in range(len(margins))])
        hess = np.zeros((len(index), len(index)))
        for r in out.select(F.explode(pairs).alias("p"), "__t").where("p.a is not null and p.b is not null").groupBy("p.a", "p.b").agg(F.sum("__t").alias("t")).collect():
            hess[r[0], r[1]] = r[2]
        return np.diag(hess).copy(), hess

    for _ in range(max_steps):
        now, hess = summed(lam)
        if np.max(np.abs(now - goal) / goal) < tolerance:
            break
        diagonal = len(margins) == 1
        step = (goal - now) / now if diagonal else np.linalg.lstsq(hess, goal - now, rcond=None)[0]
        lam = lam + np.clip(step, -2.0, 2.0)
    else:
        raise ValueError(f"the targets of the margins cannot be met together, or not within {max_steps} steps")
    return {m: {level: float(lam[where[m, level]]) if (m, level) in where else 0.0 for level in targets[m]} for m in margins}


def _changes(changes: np.ndarray, lacking: float) -> list[int]:
    """Which of the changes together come near to what is lacking: the best of all choices if there are few, else one after the other, each that helps most."""
    if len(changes) <= ALL_CHOICES:
        sums = np.zeros(1)
        for x in changes:
            sums = np.concatenate([sums, sums + x])
        best = int(np.argmin(np.abs(sums - lacking)))
        return [i for i in range(len(changes)) if best >> i & 1]
    chosen: list[int] = []
    for _ in range(FLIPS):
        i = int(np.argmin(np.abs(lacking - changes)))
        if abs(lacking - changes[i]) >= abs(lacking):
            break
        lacking -= changes[i]
        chosen.append(i)
        changes[i] = np.inf
    return chosen


def _fit_thresholds(rows: pd.DataFrame) -> pd.DataFrame:
    """For one source: by class, the hash bin below which documents get one more copy, the bin of which a part does, and bins for which it is the other way."""
    goal, whole = float(rows.goal.iloc[0]), float(rows.tokens.sum())
    out, carry, free = [], 0.0, []
    for cls, part in sorted(rows.groupby("cls"), key=lambda x: -x[0]):
        part = part.sort_values("bin")
        tokens, bins = part.tokens.to_numpy(float), part.bin.to_numpy()
        cum = np.concatenate([[0.0], np.cumsum(tokens)])
        want = goal * cum[-1] + carry
        k, edge, share = int(np.argmin(np.abs(cum - want))), -1, 0.0
        at = int(np.searchsorted(cum, want, side="right")) - 1
        if 0 <= at < len(bins) and tokens[at] > PART_SHARE * whole and part["rows"].iloc[at] >= PART_ROWS:
            k, edge, share = at, int(bins[at]), (want - cum[at]) / tokens[at]
        carry = want - cum[k] - (share * tokens[at] if edge >= 0 else 0.0)
        free += [(float(t) if i >= k else -float(t), len(out), int(b)) for i, (t, b) in enumerate(zip(tokens, bins, strict=True)) if t and b != edge]
        out.append([cls, int(bins[k - 1]) + 1 if k else 0, edge, share, []])
    for i in _changes(np.array([x[0] for x in free]), carry) if goal else []:
        out[free[i][1]][4].append(free[i][2])
    made = pd.DataFrame(out, columns=["cls", "below", "edge", "share", "flips"]).astype({"cls": "int32", "below": "int32", "edge": "int32"})
    made.insert(0, "source", [rows.source.iloc[0]] * len(out))
    return made


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, max_levels: int = 100_000) -> DataFrame:
    """By source and size class: source_size, target, whole copies and the bins in which there is one more."""
    spark = docs.sparkSession
    sized = docs.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), _bin(F.col(id_col), F.col(text_col)).alias("bin"))
    cells = written(sized.groupBy("source", _class(F.col("size")).alias("cls"), "bin").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("rows")), "cells")
    by_source = cells.groupBy("source").agg(F.sum("tokens").cast("long").alias("tokens"))
    rows = by_source.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} sources: raise max_levels if the driver can hold them")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))  # Python compares strings by code point
    sizes = [int(r[1]) for r in rows]
    goals = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], cap)
    lam = balance(by_source, {"source": {r[0]: g for r, g in zip(rows, goals, strict=True)}})["source"]
    made = []
    for r, size, goal in zip(rows, sizes, goals, strict=True):
        rate = min(float(np.exp(lam[r[0]])), cap) if size else 0.0
        rate = round(rate) if abs(rate - round(rate)) < 1e-9 else rate
        made.append((r[0], size, float(goal), int(rate), float(rate - int(rate))))
    rates = spark.createDataFrame(made, "source string, source_size long, target double, copies int, goal double")
    spread = cells.join(rates.select(F.col("source").alias("s"), "goal"), F.col("source").eqNullSafe(F.col("s"))).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source", "cls", "bin", "tokens", "rows", "goal")
    below = spread.groupBy("key").applyInPandas(lambda pdf: _fit_thresholds(pdf), "source string, cls int, below int, edge int, share double, flips array<int>")
    made = below.withColumnRenamed("source", "s").join(rates, F.col("s").eqNullSafe(F.col("source"))).select("source", "cls", "source_size", "target", "copies", "below", "edge", "share", "flips")
    return written(made, "plan")


def mixed(docs: DataFrame, made: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with __mix_size, __mix_source_size, __mix_target and __mix_copies."""
    own = docs.withColumn("__mix_size", n_words(F.col(text_col))).withColumn("__mix_bin", _bin(F.col(id_col), F.col(text_col)))
    names = {"source": "source", "cls": "cls", "source_size": "source_size", "target": "target", "copies": "whole", "below": "below", "edge": "edge", "share": "share", "flips": "flips"}
    out = own.join(made.select(*[F.col(c).alias(f"__mix_{name}") for c, name in names.items()]), F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source")) & (_class(F.col("__mix_size")) == F.col("__mix_cls")), "left")
    kept = [*docs.columns, "__mix_size", "__mix_source_size", "__mix_target"]
    under = (F.col("__mix_bin") < F.col("__mix_below")) != F.array_contains("__mix_flips", F.col("__mix_bin"))
    copies = lambda more: F.when(F.col("__mix_size") > 0, F.col("__mix_whole") + more.cast("int")).otherwise(F.lit(0)).alias("__mix_copies")
    if made.where("edge >= 0").isEmpty():
        return out.select(*kept, copies(under))
    parted = F.coalesce(F.col("__mix_bin") == F.col("__mix_edge"), F.lit(False))
    return out.where(~parted).select(*kept, copies(under)).unionByName(_numbered(out.where(parted), docs.columns).select(*kept, copies(under | (F.col("__mix_place") < F.col("__mix_share")))))


#: Steps of this part of the circle fill it evenly, whatever their number.
GOLDEN = 0.6180339887498949


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with __mix_place in [0, 1): a hash of the whole row, moved on by a golden step for each row equal to it.

    So n equal rows lie evenly in [0, 1), and how many are below a share depends on n alone, not on how the input was split.
    Equal rows are counted in each partition; the counts, not the rows, meet across partitions, so no group is in one task.
    """
    rows = rows.withColumn("__mix_key", F.xxhash64(F.to_json(F.struct(*columns)))).withColumn("__mix_part", F.spark_partition_id())
    here = Window.partitionBy("__mix_key", "__mix_part").orderBy("__mix_key")
    rows = written(rows.withColumn("__mix_row", F.row_number().over(here) - 1), "parted")
    before = Window.partitionBy("__mix_key").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__mix_key", "__mix_part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("__mix_key", "__mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_before"))
    start = F.pmod(F.xxhash64("__mix_key", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    return rows.join(counts, ["__mix_key", "__mix_part"]).withColumn("__mix_place", (start + (F.col("__mix_before") + F.col("__mix_row")) * GOLDEN) % 1)


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    out = mixed(docs, plan(docs, **columns), **columns)
    times = F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_n")
    return out.where("__mix_copies > 0").select(*docs.columns, times).drop("__mix_n")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixed(docs, plan(docs))
    return out.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).cast("long").alias("taken"), F.col("__mix_copies").cast("long").alias("copies"))
