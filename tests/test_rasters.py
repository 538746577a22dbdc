"""Hashes, banded moments and the enhance chain against plain versions; the interval sweep against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import enhance as E, image_hash, kernels
from shoebox.operators import rasters, video

RNG = np.random.default_rng(4)


def test_hashes_equal_the_kernels(spark):
    large, small = RNG.integers(0, 256, (40, 1024)), RNG.integers(0, 256, (40, 72))
    small[0, :] = 7  # no gradient anywhere
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(large, small, strict=True))], "id int, large array<int>, small array<int>")
    got = rows.select("id", image_hash.phash(F.col("large")).alias("p"), image_hash.dhash(F.col("small")).alias("d")).collect()
    assert all((r["p"], r["d"]) == (kernels.phash(large[r["id"]]), kernels.dhash(small[r["id"]])) for r in got) and len(got) == 40


def test_hashes_of_unfit_pixels(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1] * 1023), (4, [None] * 1024), (5, [None] * 72)], "id int, p array<int>")
    assert all(r["a"] is None and r["b"] is None for r in rows.select(image_hash.phash(F.col("p")).alias("a"), image_hash.dhash(F.col("p")).alias("b")).collect())
    odd = spark.createDataFrame([([3.0, 1.0, 2.0],)], "v array<double>").select(image_hash.median(F.col("v"))).first()[0]
    assert odd == 2.0


def test_hashes_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([([1] * 1024,)], "p array<int>").select(image_hash.phash(F.col("p")), image_hash.dhash(F.col("p")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


SIZES = [(1, 1), (2, 9), (3, 3), (7, 5), (16, 40), (33, 17)]


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_bands_of_any_height_give_the_whole_image(spark, rows):
    images = {i: RNG.integers(0, 256, (h, w)) for i, (w, h) in enumerate(SIZES)}
    frame = spark.createDataFrame([(i, p.shape[1], p.shape[0], p.ravel().tolist()) for i, p in images.items()], "image_id long, width int, height int, pixels array<int>")
    got = {(r["image_id"], r["measure"]): r for r in rasters.merged(rasters.gray_moments(rasters.with_halo(rasters.banded(frame, rows)))).collect()}
    for i, p in images.items():
        mean, dark, bright = kernels.brightness(p.ravel())
        r = got[i, "gray"]
        assert (r["n"], r["mean"], r["variance"], r["low_share"], r["high_share"]) == (p.size, pytest.approx(mean), pytest.approx(p.var(), abs=1e-9), dark, bright)
        if min(p.shape) >= 3:
            assert got[i, "laplacian"]["variance"] == pytest.approx(kernels.laplacian_variance(p.ravel(), p.shape[1], p.shape[0]), rel=1e-12, abs=1e-9)
            assert got[i, "laplacian"]["n"] == (p.shape[0] - 2) * (p.shape[1] - 2)
        else:
            assert (i, "laplacian") not in got


def test_moments_keep_their_digits(spark):
    """A large common level and a tiny spread: squares would cancel, merged deviations do not."""
    p = 1e8 + RNG.random((50, 4))
    frame = spark.createDataFrame([(1, 4, 50, p.ravel().tolist())], "image_id long, width int, height int, pixels array<double>")
    got = rasters.merged(rasters.gray_moments(rasters.with_halo(rasters.banded(frame, 3)))).where("measure = 'gray'").first()
    assert got["variance"] == pytest.approx(p.var(), rel=1e-6)


def test_colours(spark):
    p = RNG.integers(0, 256, (9, 6, 3))
    p[0, 0] = 0
    frame = spark.createDataFrame([(1, 6, 9, p.ravel().tolist())], "image_id long, width int, height int, pixels array<int>")
    got = {r["measure"]: r for r in rasters.merged(rasters.colour_moments(rasters.banded(frame, 2, channels=3))).collect()}
    want = dict(zip(kernels.COLOUR, kernels.colour(p), strict=True))
    assert [got[c]["mean"] for c in "rgb"] == pytest.approx([want[c] for c in "rgb"])
    s, lum = got["saturation"], got["luminance"]
    assert (s["mean"], s["variance"] ** 0.5, s["low_share"], s["high_share"], lum["mean"], lum["variance"] ** 0.5) == pytest.approx(tuple(want[c] for c in ("saturation", "saturation_std", "low_saturation", "high_saturation", "luminance", "luminance_std")))


def test_unfit_bands_count_for_nothing(spark):
    bands = spark.createDataFrame([(1, 0, 0, 3, 3, [1, 2, 3]), (1, 1, 1, 3, 3, None), (1, 2, 2, 3, 3, [7, 8]), (2, 0, 0, 3, 1, []), (3, 0, 0, 2, 1, [None, 1])], "image_id long, band int, top int, width int, height int, pixels array<int>")
    got = rasters.merged(rasters.gray_moments(rasters.with_halo(bands))).collect()
    assert [(r["image_id"], r["n"], r["mean"]) for r in got] == [(1, 3, 2.0)]
    assert rasters.merged(rasters.gray_moments(rasters.with_halo(bands.limit(0)))).count() == 0


def plain_enhanced(p, s):
    """The chain pixel by pixel, for images that shrink by whole factors."""
    h, w = len(p), len(p[0])
    whole = lambda v: max(0, min(255, math.floor(v + 0.5 + 1e-9)))
    f = max(1, -(-max(h, w) // s.max_edge))
    small = [[[sum(p[y * f + a][x * f + b][c] for a in range(f) for b in range(f)) / f / f for c in range(3)] for x in range(w // f)] for y in range(h // f)]
    for row in small:
        for x, v in enumerate(row):
            grey = 0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]
            v = [whole((grey + (c - grey) * s.saturation) * s.brightness) for c in v]
            v = [whole(s.linear_a * c + s.linear_b) for c in v]
            row[x] = [whole(255 * (c / 255) ** (1 / s.gamma)) for c in v]
    k = E.blur_kernel(s.sigma)
    reach, h, w = len(k) // 2, len(small), len(small[0])
    edge = lambda v, n: max(0, min(n - 1, v))
    return [[[whole(v + s.amount * (v - sum(k[a + reach] * k[b + reach] * small[edge(y + a, h)][edge(x + b, w)][c] for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)))) for c, v in enumerate(small[y][x])] for x in range(w)] for y in range(h)]


@pytest.mark.parametrize("settings", [E.Enhance(), E.Enhance(max_edge=4, sigma=1.3, gamma=2.2, amount=1.5), E.Enhance(max_edge=2, saturation=0.0, linear_a=1.6, linear_b=30.0)])
def test_enhance_chain(spark, settings):
    images = [RNG.integers(0, 256, (8, 8, 3)) for _ in range(6)]
    rows = spark.createDataFrame([(i, 8, p.ravel().tolist()) for i, p in enumerate(images)], "id int, width int, pixels array<int>")
    for r in rows.select("id", E.enhance(settings)(F.col("pixels"), F.col("width")).alias("e")).collect():
        want = np.array(plain_enhanced(images[r["id"]].tolist(), settings))
        assert (r["e"]["height"], r["e"]["width"]) == want.shape[:2] and r["e"]["pixels"] == want.ravel().tolist()


def test_enhance_edges(spark):
    rows = spark.createDataFrame([(1, 2, None), (2, 2, []), (3, 2, [1, 2, 3]), (4, 0, [1, 2, 3]), (5, None, [1, 2, 3]), (6, 1, [None, 2, 3]), (7, 1, [10, 20, 30])], "id int, width int, pixels array<int>")
    got = {r["id"]: r["e"] for r in rows.select("id", E.enhance(E.Enhance(sigma=0))(F.col("pixels"), F.col("width")).alias("e")).collect()}
    assert [i for i, e in got.items() if e is not None] == [7] and len(got[7]["pixels"]) == 3


def test_resampling_averages_what_a_pixel_covers():
    assert np.allclose(E.resampler(5, 2) @ np.arange(5.0), [(0 + 1 + 2 / 2) / 2.5, (2 / 2 + 3 + 4) / 2.5]) and np.allclose(E.resampler(3, 3), np.eye(3))
    out = E.enhanced(np.full((3, 300, 3), 100), E.Enhance(max_edge=100, brightness=1, saturation=1, linear_a=1, linear_b=0, gamma=1, sigma=0))
    assert out.shape == (1, 100, 3) and (out == 100).all()


def intervals(seed, n, span, longest):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = round(r.random() * span - span / 4, 2)
        out.append((i, r.choice(["m", "m", "other", None]), a, a + round(r.choice([0, 0.01, r.random() * 3, r.random() * longest]), 2)))
    return out


@pytest.mark.parametrize("span", [20.0, 50_000.0])
def test_sweep_against_brute_force(spark, span):
    segments, black = intervals(1, 150, span, span / 3), intervals(2, 150, span, span / 3)
    schema = "id long, media_id string, start double, end double"
    frames = spark.createDataFrame([], "media_id string, ts double, sharpness double")
    got = {r["id"]: r["black_seconds"] for r in video.measured(spark.createDataFrame(segments, schema), frames, spark.createDataFrame(black, schema)).collect()}
    assert len(got) == 150
    for i, m, a, b in segments:
        want = sum(max(0.0, min(b, d) - max(a, c)) for _, n, c, d in black if n == m and m is not None)
        assert got[i] == pytest.approx(want, abs=1e-6), (i, m, a, b)


def test_sweep_with_slots_and_large_times(spark):
    base = 1.7e9  # seconds since 1970
    black = spark.createDataFrame([("m", base + 10.0, base + 5000.0), ("m", base + 4000.5, base + 4001.0)], "media_id string, start double, end double")
    points = spark.createDataFrame([(1, "m", base), (2, "m", base + 20.25), (3, "m", base + 4002.0), (4, "m", base + 9000.0)], "id long, media_id string, t double")
    got = [r["covered"] for r in video.covered_before(points, black, slot=30.0).orderBy("id").collect()]
    assert got == pytest.approx([0, 10.25, 3992.5, 4990.5], abs=1e-6)


@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
def test_carried_decisions_against_brute_force(spark, least):
    new, old = intervals(3, 120, 40.0, 12), [(*o, ["keep", "remove", "undecided"][o[0] % 3]) for o in intervals(4, 120, 40.0, 20)]
    old += [(500 + i, m, a, b, "keep") for i, m, a, b in new[:20]]
    frame = lambda rows, more="": spark.createDataFrame(rows, f"id long, media_id string, start double, end double{more}")
    got = {r["id"]: (r["old_id"], r["user_decision"]) for r in video.carried_decisions(frame(new), frame(old, ", user_decision string"), least).collect()}
    for i, m, a, b in new:
        fits = [(-max(0.0, min(b, d) - max(a, c)) / (b - a), c, j, what) for j, n, c, d, what in old if n == m and m is not None and what != "undecided" and b > a]
        fits = [f for f in fits if -f[0] >= least]
        assert got[i] == (min(fits)[2:] if fits else (None, "undecided")), i
