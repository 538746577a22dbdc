"""Image statistics of rasters of any size: bands of rows with a halo, and moments that merge.

A raster is a set of bands (image_id, band, top, width, height, pixels): the rows from `top` on, flat, of an image of that size. No task
needs a whole image. The Laplacian of a band's first and last row needs the neighbours' edge rows: `with_halo` sends these two rows, and nothing
else, to the next band. Each band becomes a few rows of moments (count, mean, sum of squared deviations, counts of low and high values),
computed in numpy over Arrow batches; `merged` combines them per image without losing digits: deviations are taken from the image's mean,
never as a difference of large squares.

Defined cases: bands with null pixels or of a wrong length count for nothing; an image without inner pixels has no Laplacian row; an
empty table gives an empty result; the bands of an image may come in any order and be cut anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENTS = "image_id long, measure string, n long, mean double, m2 double, low long, high long"
#: (at most, at least) of the values counted as low and high.
GRAY, SATURATION = (30, 225), (0.1, 0.85)


def banded(images: DataFrame, rows: int, channels: int = 1) -> DataFrame:
    """Bands of `rows` rows of images (image_id, width, height, pixels); the last may be shorter."""
    starts = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows)))
    cut = images.where("width > 0 and height > 0").withColumn("top", starts)
    own = F.slice("pixels", F.col("top") * F.col("width") * channels + 1, F.least(F.lit(rows), F.col("height") - F.col("top")) * F.col("width") * channels)
    return cut.select("image_id", (F.col("top") / rows).cast("int").alias("band"), F.col("top").cast("int").alias("top"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), own.alias("pixels"))


def with_halo(bands: DataFrame) -> DataFrame:
    """Gray bands with `above` and `below`: the last row of the band before and the first row of the band after; null at the image's edge."""
    row = lambda start: F.slice("pixels", start, F.col("width"))
    good = bands.where((F.size("pixels") > 0) & (F.size("pixels") % F.col("width") == 0))
    edges = good.select("image_id", (F.col("band") + 1).alias("band"), row(F.size("pixels") - F.col("width") + 1).alias("above"), F.lit(None).cast(dict(bands.dtypes)["pixels"]).alias("below"))
    edges = edges.unionByName(good.select("image_id", (F.col("band") - 1).alias("band"), F.lit(None).cast(dict(bands.dtypes)["pixels"]).alias("above"), row(F.lit(1)).alias("below")))
    edges = edges.groupBy("image_id", "band").agg(F.first("above", ignorenulls=True).alias("above"), F.first("below", ignorenulls=True).alias("below"))
    return bands.join(edges, ["image_id", "band"], "left")


def _moments(values: np.ndarray, limits: tuple[float, float] | None = None) -> tuple:
    mean = float(values.mean())
    low, high = (int((values <= limits[0]).sum()), int((values >= limits[1]).sum())) if limits else (0, 0)
    return values.size, mean, float(((values - mean) ** 2).sum()), low, high


def _pixels(value, width: int, channels: int = 1) -> np.ndarray | None:
    """Rows of pixels, or None if they are null or do not fill rows."""
    if value is None or width <= 0 or len(value) == 0 or len(value) % (width * channels):
        return None
    out = np.asarray(value, dtype=float)
    return None if np.isnan(out).any() else out.reshape(-1, width, channels) if channels > 1 else out.reshape(-1, width)


def gray_moments(bands: DataFrame) -> DataFrame:
    """Moments of gray values and of the Laplacian's response at inner pixels, of bands with a halo."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for image, width, pixels, above, below in zip(part["image_id"], part["width"], part["pixels"], part["above"], part["below"], strict=True):
                own = _pixels(pixels, width)
                if own is None:
                    continue
                out.append((image, "gray", *_moments(own, GRAY)))
                whole = np.concatenate([x for x in (_pixels(above, width), own, _pixels(below, width)) if x is not None])
                if width >= 3 and len(whole) >= 3:
                    out.append((image, "laplacian", *_moments(4 * whole[1:-1, 1:-1] - whole[:-2, 1:-1] - whole[2:, 1:-1] - whole[1:-1, :-2] - whole[1:-1, 2:])))
            yield pd.DataFrame(out, columns=["image_id", "measure", "n", "mean", "m2", "low", "high"])

    return bands.select("image_id", "width", "pixels", "above", "below").mapInPandas(run, MOMENTS)


def colour_moments(bands: DataFrame) -> DataFrame:
    """Moments of the channels, saturation and luminance of RGB bands (three values a pixel)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for image, width, pixels in zip(part["image_id"], part["width"], part["pixels"], strict=True):
                own = _pixels(pixels, width, 3)
                if own is None:
                    continue
                top, bottom = own.max(axis=2), own.min(axis=2)
                saturation = np.divide(top - bottom, top, out=np.zeros_like(top), where=top > 0)
                out += [(image, name, *_moments(own[:, :, i])) for i, name in enumerate("rgb")]
                out += [(image, "saturation", *_moments(saturation, SATURATION)), (image, "luminance", *_moments(own @ np.array([0.299, 0.587, 0.114])))]
            yield pd.DataFrame(out, columns=["image_id", "measure", "n", "mean", "m2", "low", "high"])

    return bands.select("image_id", "width", "pixels").mapInPandas(run, MOMENTS)


def merged(moments: DataFrame, *more: str) -> DataFrame:
    """(image_id, measure, n, mean, variance, low_share, high_share) of whole images from the moments of their bands."""
    keys = ["image_id", "measure", *more]
    image = Window.partitionBy(*keys)  # rows without pixels: a few numbers for each band
    mean = F.sum(F.col("n") * F.col("mean")).over(image) / F.sum("n").over(image)
    rows = moments.withColumn("__mean", mean)
    n = F.sum("n")
    squares = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) ** 2)
    return rows.groupBy(*keys).agg(n.alias("n"), F.first("__mean").alias("mean"), (squares / n).alias("variance"), (F.sum("low") / n).alias("low_share"), (F.sum("high") / n).alias("high_share"))
