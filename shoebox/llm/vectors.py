"""Vectors of Arrow list columns as numpy matrices, within tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, begins, lengths, whether a vector is there with finite entries only) of a list column."""
    lists = lists.cast(pa.large_list(pa.float64()))
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    return values, ends[:-1], np.diff(ends), there & (bad[ends[1:]] == bad[ends[:-1]])


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their vectors): those with dim entries, none null or not finite."""
    values, begins, lengths, good = usable(lists)
    rows = np.flatnonzero(good & (lengths == dim))
    if len(rows) and (np.diff(begins[rows]) == dim).all():
        return rows, values[begins[rows[0]] : begins[rows[-1]] + dim].reshape(-1, dim)
    return rows, values[begins[rows][:, None] + np.arange(dim)]


def floored(x: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * x) as integers; an error beyond the bound, where later sums would not be exact."""
    y = np.floor(scale * x)
    if y.size and np.abs(y).max() > bound:
        raise ValueError(f"a component beyond {bound} / {scale} cannot be summed exactly")
    return y.astype(np.int64)


def list_array(x: np.ndarray) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
