"""Operators 11 to 13 against plain Python, and their defined cases."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from shoebox.llm import centroid_clustering as C, toxicity as T, whitening as W
from shoebox.llm.text_hash import pieces

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x array<int>, owner int, component int"


def made(n=400, dim=6, seed=5):
    r = random.Random(seed)
    rows = [(i, [r.gauss((i % 3) * (j % 2), 0.3 + 0.05 * j) for j in range(dim)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (7, rows[7][1]), (None, rows[3][1])]  # equal vectors, repeated ids, no id
    rows += [(n + 2, None), (n + 3, []), (n + 4, [1.0] * (dim - 1)), (n + 5, [None] * dim), (n + 6, [math.nan] + [1.0] * (dim - 1)), (n + 7, [1.0] * (dim - 1) + [-math.inf]), (n + 8, [1.0] * (dim - 1) + [None])]
    return rows


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame([(i, v, 1, 5, [1], 9, 3) for i, v in made()], SCHEMA).repartition(7)


def kept(rows, dim=6):
    f = np.float32
    return [(i, [float(f(c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def plain_lloyd(rows, k, rounds, scale):
    own = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    seeds = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [c for _, c in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        owner = [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in own]
        for j in range(len(centroids)):
            if members := [x for (_, x), o in zip(own, owner, strict=True) if o == j]:
                centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    owner = [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in own]
    return sorted((-1 if i is None else i, o, far(x, centroids[o])) for (i, x), o in zip(own, owner, strict=True)), centroids


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (8, 1), (3, 0), (1, 4), (500, 2)])
def test_delta_rounds_are_plain_rounds(vectors, k, rounds):
    members, centroids = C.clustered(vectors, k=k, rounds=rounds, dim=6)
    want, plain = plain_lloyd(kept(made()), k, rounds, 1024)
    assert sorted((-1 if r["id"] is None else r["id"], r["cluster"], r["distance"]) for r in members.collect()) == want
    assert centroids.tolist() == plain


def test_only_moved_centroids_are_met():
    rng = np.random.default_rng(3)
    x, before = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (6, 4))
    owner, distance = C.nearest(x, np.full(300, -1), np.full(300, -1), before, np.ones(6, bool))
    after = before.copy()
    after[2] += 9
    after[5] = after[1]  # a tie with a smaller number
    moved = (after != before).any(axis=1)
    got = C.nearest(x, owner, distance, after, moved)
    every = C.distances(x, after)
    assert (got[0] == every.argmin(axis=1)).all() and (got[1] == every.min(axis=1)).all()


def test_large_components_stay_exact():
    x = np.array([[1 << 27, -(1 << 27), 1], [3, 4, 5]])
    c = np.array([[-(1 << 27), 1 << 27, 0], [0, 0, 0]])
    assert C.distances(x, c).tolist() == [[(1 << 57) + 1, (1 << 55) + 1], [int(((x[1] - c[0]) ** 2).sum()), 50]]


def test_clustering_edges(spark, vectors):
    assert C.clustered(vectors.limit(0), dim=6)[0].count() == 0
    few, centroids = C.clustered(vectors.where("vec_id in (1, 2)"), dim=6)
    assert few.count() == 2 and len(centroids) == 2
    with pytest.raises(Exception, match="cannot be summed exactly"):
        C.clustered(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dim=2)


def test_clustering_agrees_with_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = C.op12_centroid_clustering(spark, sf)
    want = duck.execute(C.ORACLE)
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert sorted(map(tuple, got.select(*[c[0] for c in want.description]).collect())) == sorted(want.fetchall())


def test_jacobi_against_lapack_and_small_eigenvalues():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 20))
    a = m @ m.T
    values, axes = W.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(axes.T @ axes, np.eye(20), atol=1e-12) and np.allclose(a @ axes, axes * values)
    # A graded positive matrix: each eigenvalue has a small relative error, although they span twenty orders of magnitude.
    scale = np.diag(10.0 ** -np.arange(0, 12, 2))
    core = np.eye(6) + 0.1 * np.ones((6, 6))
    got, _ = W.jacobi(scale @ core @ scale)
    assert abs(np.prod(got / np.diag(scale) ** 2) - np.linalg.det(core)) < 1e-9 and all(got > 0)


def plain_whitening(rows, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = n * x - s
    y = (deviation / n).astype(float)
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return n, [int(d) for d in (deviation**2).sum(axis=1)], y, v, e[::-1][:components], q[:, ::-1][:, :components]


def test_whitening_against_plain(vectors):
    frame = vectors.selectExpr("vec_id as id", "cast(embedding as array<double>) as v")
    rows = kept(made())
    n, deviation, y, v, e, q = plain_whitening(rows, 4)
    fit = W.fitted(frame, components=4)
    assert fit.n == n and np.allclose(fit.values, e) and W.identity_error(frame, fit) < 1e-10
    got = {}
    for r in W.whitened(frame, fit).collect():
        got.setdefault((r["id"], r["component"]), []).append(r)
    assert sum(map(len, got.values())) == 4 * n
    signs = [np.sign((q[:, j] * fit.projection[:, j]).sum()) for j in range(4)]
    for (i, _), d, own in zip(rows, deviation, y, strict=True):
        for j in range(4):
            assert any(r["deviation"] == d and abs(r["whitened"] - signs[j] * (own @ q[:, j]) / math.sqrt(e[j])) < 1e-9 and abs(r["explained"] - e[j] / np.trace(v)) < 1e-12 for r in got[i, j + 1])


def test_whitening_edges(spark, vectors):
    frame = vectors.selectExpr("vec_id as id", "cast(embedding as array<double>) as v")
    assert W.fitted(frame.limit(0)) is None
    one = frame.where("id = 1")
    assert W.whitened(one, W.fitted(one)).count() == 0  # no variance, no components
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "id long, v array<double>")
    fit = W.fitted(flat)
    assert len(fit.values) == 1 and W.whitened(flat, fit).count() == 10 and W.identity_error(flat, fit) < 1e-9
    large = spark.createDataFrame([(i, [1e9 * (i % 7), 1.0 * i]) for i in range(50)], "id long, v array<double>")
    fit = W.fitted(large)
    rows = W.whitened(large, fit).collect()
    n, deviation, *_ = plain_whitening([(i, [1e9 * (i % 7), 1.0 * i]) for i in range(50)], 2)
    assert [r["deviation"] for r in sorted(rows) if r["component"] == 1] == [d if d < 1 << 63 else None for d in deviation]


def test_query_whitening(spark, sf):
    rows = W.op13_whitening(spark, sf).collect()
    assert len(rows) == 32 * len({r["vec_id"] for r in rows}) and max(r["identity_error"] for r in rows) < 1e-9
    assert sum(r["explained"] for r in rows) / rows[0]["n"] < 1.0


def terms_of(texts):
    out = []
    for _, _, data, offsets in pieces(pc.utf8_lower(pa.array(texts, pa.string()))):
        ends, term = T.terms(data, offsets)
        out += [term[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out


def test_terms():
    one, two, three, empty, none, stem, other = terms_of(["Stupid, stupid IDIOT%%%", "idiot stupid", "a-b_c", "", None, "loweischaft", "loweient"])
    assert set(one.tolist()) == set(two.tolist()) and len(three) == 3 and len(empty) == len(none) == 0
    assert len(np.intersect1d(stem, other)) == 2  # the stems of four and five bytes
    assert len(stem) == 5 and len(terms_of(["éé"])[0]) == 1


def scores(model, rows):
    return model.score(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), np.concatenate([*rows, np.empty(0, np.uint64)]))


@pytest.mark.parametrize("filler", [5, 20])
def test_pairs_that_additive_weights_cannot_tell(filler):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}x" for _ in range(400)]
    rows, y = [], []
    for _ in range(1200):
        a, b = r.randrange(2), r.randrange(2)
        rows.append(" ".join(r.sample([*(r.choice(words) for _ in range(filler)), ("crook", "saint")[a], ("martians", "venusians")[b]], filler + 2)))
        y.append(int(a == b))
    rows, y = terms_of(rows), np.array(y)
    right = [((scores(T.fit(rows[:800], y[:800], rank=rank), rows[800:]) >= 0.5) == y[800:]).mean() for rank in (0, T.RANK)]
    assert right[0] < 0.6 and right[1] > 0.97


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = T.Model(np.arange(10, 20, dtype=np.uint64), rng.normal(size=10), rng.normal(size=(10, 3)), 0.3)
    x = np.array([3, 11, 14, 15, 19, 40], np.uint64)
    own = [1, 4, 5, 9]
    pairs = sum(model.factors[i] @ model.factors[j] for i in own for j in own if i < j)
    got = model.margins(np.array([0, 0, 6]), x)
    assert got[0] == pytest.approx(0.3) and got[1] == pytest.approx(0.3 + model.weights[own].sum() + pairs / 4)


def test_toxicity_cases(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(1, 12)] + [(None, 1, 0), (3, None, 0), (2, 1, 9)], "doc_id long, toxic int, quality int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        out = T.scored(docs, T.train(docs, known)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert T.scored(no_docs, T.train(no_docs, labels)).count() == 0
    assert T.scored(docs, T.train(docs, labels.limit(0))).first()["score"] == pytest.approx(0.5)
    long = spark.createDataFrame([(1, "word " * 400_000 + "x" * 3_000_000), (2, "Ab " * 10)], "doc_id long, text string")
    assert T.scored(long, T.train(docs, labels)).count() == 2


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    out = T.op11_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    caught = sum(r["predicted"] for r in out if r["toxic"])
    wrong = sum(r["predicted"] for r in out if not r["toxic"])
    assert caught >= 0.75 * sum(r["toxic"] for r in out) and wrong <= 0.005 * len(out)
