"""Registered queries over pixel grids, which are made in the JVM from the vectors of `embeddings`: 8 x 8 values from 0 to 255."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import image_hash
from ..functions.enhance import Enhance, blur_kernel, enhance
from ..operators import rasters
from .queries import query


def _value(c):
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 300 * c.cast("double"))))


def grids(get, places: list[int]):
    """(image_id, pixels): the vectors' entries at these places (from 0, around the end), as pixels."""
    at = F.array(*[F.lit(p % 64) for p in places])
    return get("embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("image_id"), F.transform(at, lambda i: _value(F.get("embedding", i)).cast("int")).alias("pixels"))


_VALUE = "floor(greatest(0.0, least(255.0, 128 + 300 * CAST(embedding[1 + {place} % 64] AS DOUBLE))))"
_HEX = "lpad(lower(printf('%x', CAST(sum(CASE WHEN bit THEN CAST(1 AS UBIGINT) << (63 - place) ELSE 0 END) AS UBIGINT))), 16, '0')"


@query(f"""WITH px AS (SELECT vec_id, y, x, {_VALUE.format(place="((y // 4) * 8 + x // 4)")} AS p FROM embeddings, range(32) AS a(y), range(32) AS b(x)),
across AS (SELECT vec_id, y, u, sum(p * cos(pi() / 32 * (x + 0.5) * u)) AS t FROM px, range(8) AS c(u) GROUP BY vec_id, y, u),
terms AS (SELECT vec_id, v, u, sum(t * cos(pi() / 32 * (y + 0.5) * v)) AS t FROM across, range(8) AS d(v) GROUP BY vec_id, v, u),
bits AS (SELECT vec_id, v * 8 + u AS place, t > median(t) OVER (PARTITION BY vec_id) AS bit FROM terms),
ph AS (SELECT vec_id, {_HEX} AS phash FROM bits GROUP BY vec_id),
g AS (SELECT vec_id, y * 8 + x AS place, {_VALUE.format(place="(y * 9 + x)")} > {_VALUE.format(place="(y * 9 + x + 1)")} AS bit FROM embeddings, range(8) AS a(y), range(8) AS b(x)),
dh AS (SELECT vec_id, {_HEX} AS dhash FROM g GROUP BY vec_id)
SELECT vec_id AS image_id, phash, dhash FROM ph JOIN dh USING (vec_id)""")
def k2_k3_image_hashes(get):
    large = grids(get, [(y // 4) * 8 + x // 4 for y in range(32) for x in range(32)]).select("image_id", image_hash.phash(F.col("pixels")).alias("phash"))
    small = grids(get, list(range(72))).select("image_id", image_hash.dhash(F.col("pixels")).alias("dhash"))
    return large.join(small, "image_id")


@query(f"""WITH px AS (SELECT vec_id, y, x, {_VALUE.format(place="(y * 8 + x)")} AS p FROM embeddings, range(8) AS a(y), range(8) AS b(x)),
l AS (SELECT c.vec_id, 4 * c.p - u.p - d.p - l.p - r.p AS v FROM px c JOIN px u ON u.vec_id = c.vec_id AND u.y = c.y - 1 AND u.x = c.x JOIN px d ON d.vec_id = c.vec_id AND d.y = c.y + 1 AND d.x = c.x
 JOIN px l ON l.vec_id = c.vec_id AND l.y = c.y AND l.x = c.x - 1 JOIN px r ON r.vec_id = c.vec_id AND r.y = c.y AND r.x = c.x + 1)
SELECT vec_id AS image_id, 'gray' AS measure, count(*) AS n, round(avg(p), 9) AS mean, round(var_pop(p), 7) AS variance, round(count(*) FILTER (p <= 30) / 64.0, 9) AS low_share, round(count(*) FILTER (p >= 225) / 64.0, 9) AS high_share FROM px GROUP BY vec_id
UNION ALL SELECT vec_id, 'laplacian', count(*), round(avg(v), 9), round(var_pop(v), 7), 0.0, 0.0 FROM l GROUP BY vec_id""")
def a15_a16_banded_moments(get):
    images = grids(get, list(range(64))).withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    out = rasters.merged(rasters.gray_moments(rasters.with_halo(rasters.banded(images, 3))))
    return out.select("image_id", "measure", "n", *[F.round(c, 7 if c == "variance" else 9).alias(c) for c in ("mean", "variance", "low_share", "high_share")])


_RGB = f"px AS (SELECT vec_id, y, x, {_VALUE.format(place='(y * 8 + x)')} AS r, {_VALUE.format(place='(y * 8 + x + 7)')} AS g, {_VALUE.format(place='(y * 8 + x + 19)')} AS b FROM embeddings, range(8) AS a(y), range(8) AS c(x))"
COLOUR_PLACES = [p + shift for p in range(64) for shift in (0, 7, 19)]


@query(f"""WITH {_RGB},
m AS (SELECT vec_id, unnest(['r', 'g', 'b', 'saturation', 'luminance']) AS measure, unnest([r, g, b, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END, 0.299 * r + 0.587 * g + 0.114 * b]) AS v FROM px)
SELECT vec_id AS image_id, measure, count(*) AS n, round(avg(v), 8) AS mean, round(var_pop(v), 7) AS variance, round(count(*) FILTER (measure = 'saturation' AND v <= 0.1) / 64.0, 9) AS low_share, round(count(*) FILTER (measure = 'saturation' AND v >= 0.85) / 64.0, 9) AS high_share FROM m GROUP BY vec_id, measure""")
def a17_banded_colours(get):
    images = grids(get, COLOUR_PLACES).withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    out = rasters.merged(rasters.colour_moments(rasters.banded(images, 5, channels=3)))
    return out.select("image_id", "measure", "n", F.round("mean", 8).alias("mean"), F.round("variance", 7).alias("variance"), F.round("low_share", 9).alias("low_share"), F.round("high_share", 9).alias("high_share"))


CHAIN = Enhance(max_edge=4, sigma=0.5)


def _enhance_sql() -> str:
    """The chain over blocks of 2 x 2 pixels, a common table for each step."""
    whole = lambda v: f"greatest(0, least(255, floor({v} + 0.5 + 1e-9)))"
    s, k = CHAIN, blur_kernel(CHAIN.sigma)
    reach = len(k) // 2
    kernel = ", ".join(f"({i - reach}, {float(w)!r})" for i, w in enumerate(k))
    grey = "(0.299 * r + 0.587 * g + 0.114 * b)"
    each = lambda f: ", ".join(f"{f(c)} AS {c}" for c in "rgb")
    return f"""WITH {_RGB}, k(o, w) AS (VALUES {kernel}),
small AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, {each(lambda c: f"avg({c})")} FROM px GROUP BY vec_id, y // 2, x // 2),
modulated AS (SELECT vec_id, y, x, {each(lambda c: whole(f"({grey} + ({c} - {grey}) * {s.saturation}) * {s.brightness}"))} FROM small),
linear AS (SELECT vec_id, y, x, {each(lambda c: whole(f"{s.linear_a} * {c} + {s.linear_b}"))} FROM modulated),
lifted AS (SELECT vec_id, y, x, {each(lambda c: whole(f"255 * pow({c} / 255, 1 / {s.gamma})"))} FROM linear),
down AS (SELECT a.vec_id, a.y, a.x, {each(lambda c: f"sum(k.w * n.{c})")} FROM lifted a CROSS JOIN k JOIN lifted n ON n.vec_id = a.vec_id AND n.x = a.x AND n.y = greatest(0, least(3, a.y + k.o)) GROUP BY a.vec_id, a.y, a.x),
blurred AS (SELECT a.vec_id, a.y, a.x, {each(lambda c: f"sum(k.w * n.{c})")} FROM down a CROSS JOIN k JOIN down n ON n.vec_id = a.vec_id AND n.y = a.y AND n.x = greatest(0, least(3, a.x + k.o)) GROUP BY a.vec_id, a.y, a.x)
SELECT a.vec_id AS image_id, a.y AS y, a.x AS x, {", ".join(f"CAST({whole(f'a.{c} + {s.amount} * (a.{c} - m.{c})')} AS BIGINT) AS {c}" for c in "rgb")} FROM lifted a JOIN blurred m ON m.vec_id = a.vec_id AND m.y = a.y AND m.x = a.x"""


@query(_enhance_sql())
def s16_enhanced_pixels(get):
    out = grids(get, COLOUR_PLACES).select("image_id", enhance(CHAIN)(F.col("pixels"), F.lit(8)).alias("e"))
    place = out.select("image_id", F.col("e.width").alias("w"), F.col("e.pixels").alias("p"), F.explode(F.sequence(F.lit(0), F.col("e.width") * F.col("e.height") - 1)).alias("i"))
    return place.select("image_id", F.floor(F.col("i") / F.col("w")).alias("y"), (F.col("i") % F.col("w")).cast("long").alias("x"), *[F.get("p", F.col("i") * 3 + k).cast("long").alias(c) for k, c in enumerate("rgb")])
