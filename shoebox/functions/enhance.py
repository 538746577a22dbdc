"""The enhance chain on pixel arrays: bound the longest edge, modulate, linear, gamma, unsharp mask; whole numbers from 0 to 255 in and out.

Steps are in the order of a photo's enhancement. Decoding and encoding of files is an adapter's work. Resampling is separable
(each output pixel is the mean of the input it covers, along rows, then columns) and never enlarges; saturation is scaled about the luminance;
gamma is a table of 256 values; the unsharp mask blurs with a separable kernel, edges repeated. A photo codec's own resampler or colour space
gives slightly other values. Pixels that are null or do not fill rows of the width give null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

RESULT = "width int, height int, pixels array<int>"


@dataclass(frozen=True)
class Enhance:
    max_edge: int = 4096
    brightness: float = 1.03
    saturation: float = 1.05
    linear_a: float = 1.04
    linear_b: float = -4.0
    gamma: float = 1.05
    sigma: float = 0.8
    amount: float = 0.6


def _whole(x: np.ndarray) -> np.ndarray:
    """The nearest whole numbers from 0 to 255, halves up; what rounding leaves below a half counts as a half."""
    return np.clip(np.floor(x + 0.5 + 1e-9), 0, 255)


def resampler(size: int, new: int) -> np.ndarray:
    """Weights (new x size) that average what each output pixel covers."""
    edges = np.arange(new + 1) * (size / new)
    begin, end = np.maximum(edges[:-1, None], np.arange(size)), np.minimum(edges[1:, None], np.arange(size) + 1)
    weights = np.maximum(end - begin, 0)
    return weights / weights.sum(axis=1, keepdims=True)


def blur_kernel(sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _blurred(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    reach = len(kernel) // 2
    for axis in (0, 1):
        wide = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        x = sum(w * np.take(wide, np.arange(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return x


def enhanced(pixels: np.ndarray, s: Enhance = Enhance()) -> np.ndarray:
    """The chain over one image (height x width x 3)."""
    x = np.asarray(pixels, dtype=float)
    h, w, _ = x.shape
    shrink = min(1.0, s.max_edge / max(h, w))
    if shrink < 1:
        x = np.einsum("ya,abc,xb->yxc", resampler(h, max(1, round(h * shrink))), x, resampler(w, max(1, round(w * shrink))))
    grey = (x @ np.array([0.299, 0.587, 0.114]))[:, :, None]
    x = _whole((grey + (x - grey) * s.saturation) * s.brightness)
    x = _whole(s.linear_a * x + s.linear_b)
    table = _whole(255 * (np.arange(256) / 255) ** (1 / s.gamma))
    x = table[x.astype(int)]
    if s.sigma > 0:
        x = _whole(x + s.amount * (x - _blurred(x, blur_kernel(s.sigma))))
    return x.astype(np.int32)


def enhance(settings: Enhance = Enhance()):
    """A column function (pixels, width) -> struct of RESULT, over Arrow batches."""

    def one(values, width) -> tuple:
        if values is None or not width > 0 or len(values) == 0 or len(values) % int(3 * width):
            return None, None, None
        x = np.asarray(values, dtype=float)
        if np.isnan(x).any():
            return None, None, None
        out = enhanced(x.reshape(-1, int(width), 3), settings)
        return out.shape[1], out.shape[0], out.reshape(-1)

    def run(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = [one(p, w) for p, w in zip(pixels, width, strict=True)]
        return pd.DataFrame({"width": pd.array([r[0] for r in rows], dtype="Int32"), "height": pd.array([r[1] for r in rows], dtype="Int32"), "pixels": pd.Series([r[2] for r in rows], dtype=object)})

    run.__annotations__ = {"pixels": pd.Series, "width": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(run, RESULT)
    return lambda pixels, width: F.transform(F.array(made(pixels, width)), lambda r: F.when(r["width"].isNotNull(), r))[0]
