"""Pixel kernels as Arrow UDFs: image hashes, sharpness, exposure and colour statistics of raw pixel arrays.

Pixels come as flat byte arrays (gray, or interleaved RGB) with width and height; decoding files to
pixels is an adapter's work. Null, or a length that does not fit the size, gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

_N = 32
_BASIS = np.cos(np.pi / _N * (np.arange(_N) + 0.5)[None] * np.arange(8)[:, None])


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def phash(gray: np.ndarray) -> str:
    """Of 32 x 32 gray pixels: the 8 x 8 low cosine terms against their median, first bit highest."""
    low = _BASIS @ gray.reshape(_N, _N).astype(float) @ _BASIS.T
    return _hex(low > np.median(low))


def dhash(gray: np.ndarray) -> str:
    """Of 9 x 8 gray pixels: whether each is brighter than the next."""
    g = gray.reshape(8, 9).astype(int)
    return _hex(g[:, :-1] > g[:, 1:])


def laplacian_variance(gray: np.ndarray, width: int, height: int) -> float:
    """Population variance of the 4-neighbour Laplacian of inner pixels; 0 if there are none."""
    g = gray.reshape(height, width).astype(float)
    if width < 3 or height < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def brightness(gray: np.ndarray, dark: int = 30, bright: int = 225) -> tuple[float, float, float]:
    """Mean, share of dark pixels, share of bright pixels."""
    return float(gray.mean()), float((gray <= dark).mean()), float((gray >= bright).mean())


def colour(rgb: np.ndarray, low: float = 0.1, high: float = 0.85) -> tuple[float, ...]:
    """Means of R, G, B; mean and deviation of saturation; shares of low and high saturation; mean and deviation of luminance."""
    p = rgb.reshape(-1, 3).astype(float)
    top, bottom = p.max(1), p.min(1)
    sat = np.divide(top - bottom, top, out=np.zeros(len(p)), where=top > 0)
    lum = p @ np.array([0.299, 0.587, 0.114])
    return (*p.mean(0).tolist(), float(sat.mean()), float(sat.std()), float((sat <= low).mean()), float((sat >= high).mean()), float(lum.mean()), float(lum.std()))


def _each(fn, *columns: pd.Series) -> list:
    return [None if any(x is None for x in row) else fn(*row) for row in zip(*columns, strict=True)]


def _pixels(data: bytes, size: int) -> np.ndarray | None:
    out = np.frombuffer(data, np.uint8)
    return out if len(out) == size and size else None


def _doubles(*names: str) -> StructType:
    """The type as an object: to parse a text for it, importing this module would need a session."""
    return StructType([StructField(n, DoubleType()) for n in names])


@F.pandas_udf(StringType())
def phash_udf(gray: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda d: None if (p := _pixels(d, 1024)) is None else phash(p), gray), dtype=object)


@F.pandas_udf(StringType())
def dhash_udf(gray: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda d: None if (p := _pixels(d, 72)) is None else dhash(p), gray), dtype=object)


@F.pandas_udf(DoubleType())
def sharpness_udf(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda d, w, h: None if (p := _pixels(d, int(w) * int(h))) is None else laplacian_variance(p, int(w), int(h)), gray, width, height), dtype=float)


@F.pandas_udf(_doubles("mean", "dark", "bright"))
def brightness_udf(gray: pd.Series) -> pd.DataFrame:
    rows = _each(lambda d: brightness(np.frombuffer(d, np.uint8)) if len(d) else None, gray)
    return pd.DataFrame([r or (None,) * 3 for r in rows], columns=["mean", "dark", "bright"], dtype=float)


COLOUR = ("r", "g", "b", "saturation", "saturation_std", "low_saturation", "high_saturation", "luminance", "luminance_std")


@F.pandas_udf(_doubles(*COLOUR))
def colour_udf(rgb: pd.Series) -> pd.DataFrame:
    rows = _each(lambda d: colour(np.frombuffer(d, np.uint8)) if len(d) and len(d) % 3 == 0 else None, rgb)
    return pd.DataFrame([r or (None,) * len(COLOUR) for r in rows], columns=list(COLOUR), dtype=float)
