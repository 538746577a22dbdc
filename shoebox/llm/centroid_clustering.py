"""Centroid clustering: delta Lloyd on integer vectors (operator 12).

A table in the shared folder keeps, for each vector, its components, its owner (the nearest centroid), the owner before and the distance; the
driver keeps each centroid's member count and component sums as exact integers. A round

1. rewrites the table: a vector whose owner did not move meets only the centroids that moved (the others are as far as before,
   and were no nearer); a vector whose owner moved meets all of them;
2. sums signed transfers, only over vectors that changed hands: minus at the old owner, plus at the new one. These k rows are all
   that is shuffled and collected; they bring the kept sums up to date.

The result is that of plain Lloyd rounds to the last bit. When no centroid moves, further rounds change nothing and are left out. The
table of a round is removed when the next one is written, so disk stays at two copies, and a lost
executor only repeats tasks of the current round. Nothing is grouped by cluster but partial sums, so a cluster with most of the
vectors costs no more than a small one.

Defined cases: vectors that are null, of another length, or with null or non-finite entries are left out; equal distances
go to the smaller number; repeated rows are vectors of their own; seeds with equal hashes go by components, and null ids come last
as seeds; with fewer than k vectors each is a centroid; a centroid without members stays where it is; an empty
table gives an empty result; a component beyond 2 ** 27 after scaling is an error, as its squared distance would not fit a long; other
columns are not read. (Texts do not occur.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import floored, list_array, matrix

K, ROUNDS, DIM, SCALE, SALT = 8, 10, 64, 1024, "3"
BOUND = 1 << 27
_STATE = "id long, x array<int>, was int, owner int, distance long"


def _kept(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            x = floored(x, scale, BOUND).astype(np.int32)
            none = np.full(len(rows), -1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), list_array(x), pa.array(none), pa.array(none), pa.array(none.astype(np.int64))], ["id", "x", "was", "owner", "distance"])

    return run


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < 1 << 53:  # every sum is exact in a double
        x, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new owners and distances of vectors with owners (-1: none yet), if only the centroids `moved` are not where they were."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | moved[owner]
    for rows, numbers in ((np.flatnonzero(anew), np.arange(len(centroids))), (np.flatnonzero(~anew), np.flatnonzero(moved))):
        if not len(rows) or not len(numbers):
            continue
        d = distances(x[rows], centroids[numbers])
        at = d.argmin(axis=1)  # the first, so the smallest number
        best, number = d[np.arange(len(rows)), at], numbers[at]
        take = anew[rows] | (best < distance[rows]) | ((best == distance[rows]) & (number < owner[rows]))
        owner[rows[take]], distance[rows[take]] = number[take], best[take]
    return owner, distance


def _assigned(centroids: np.ndarray, moved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten().to_numpy().reshape(len(lists), centroids.shape[1])
            was = batch.column(3)
            owner, distance = nearest(x, was.to_numpy(), batch.column(4).to_numpy(), centroids, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, was, pa.array(owner.astype(np.int32)), pa.array(distance)], ["id", "x", "was", "owner", "distance"])

    return run


def _transfers(state: DataFrame, dim: int) -> list:
    """For each cluster the signed count and component sums of the vectors that came and went."""
    sides = F.explode(F.array(F.struct(F.col("owner").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("k"), F.lit(-1).alias("sign")))).alias("side")
    rows = state.where("was <> owner").select("x", sides).where("side.k >= 0")
    sums = [F.sum((F.col("x")[i] * F.col("side.sign")).cast("long")).alias(f"s{i}") for i in range(dim)]
    return rows.groupBy(F.col("side.k").alias("k")).agg(F.sum("side.sign").alias("n"), *sums).collect()  # k rows


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector kept, the final centroids)."""
    scratch = Scratch(vectors.sparkSession)
    state = scratch.write(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_kept(dim, scale), _STATE), "start")
    order = [F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x"]
    seeds = state.orderBy(*order).select("x").limit(k).collect()
    centroids = np.array([r["x"] for r in seeds], dtype=np.int64).reshape(-1, dim)
    count, total = np.zeros(len(centroids), dtype=object), np.zeros(centroids.shape, dtype=object)
    moved, last = np.ones(len(centroids), dtype=bool), "start"
    for round_ in range(rounds + 1) if len(centroids) else ():
        state = scratch.write(state.mapInArrow(_assigned(centroids, moved), _STATE), f"round{round_}")
        scratch.remove(last)
        last = f"round{round_}"
        if round_ == rounds:
            break
        for r in _transfers(state, dim):
            count[r["k"]] += r["n"]
            total[r["k"]] += np.array(r[2:], dtype=object)
        new = np.array([[int(s) // int(n) for s in t] if n else c for n, t, c in zip(count, total, centroids.tolist(), strict=True)], dtype=np.int64)
        moved = (new != centroids).any(axis=1)
        centroids = new
        if not moved.any():
            break
    return state.select("id", F.col("owner").alias("cluster"), "distance"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = clustered(table(spark, sf_dir, "embeddings"))
    inertia = {r[0]: int(r[1]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """Plain rounds without deltas: all distances, then all sums anew."""
    seed = f"sha256('{SALT}:' || CAST(vec_id AS VARCHAR))"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: coalesce(NOT isfinite(e), true))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {seed}, x) - 1 AS k, x AS c FROM v ORDER BY {seed}, x LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, x, any_value(vec_id) AS vec_id, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM
 (SELECT v.r, v.vec_id, v.x, k, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) AS d FROM v CROSS JOIN c{i}) GROUP BY r, x)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN
 (SELECT k, list(m ORDER BY j) AS c FROM (SELECT k, j, floor(sum(e) / count(*)) AS m FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k) n USING (k))""")
    return f"""WITH {", ".join(parts)},
s AS (SELECT k, CAST(sum(d) AS BIGINT) AS own FROM a{rounds} GROUP BY k)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, s.own AS cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c.c, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN s USING (k) JOIN c{rounds} c USING (k)"""


ORACLE = _oracle()
