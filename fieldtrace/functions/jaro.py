"""Jaro distance of text pairs, whole Arrow batches at a time."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors receive this module with the function and need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELLS = 2_000_000  # characters of padded text held at once


def _letters(texts: np.ndarray) -> np.ndarray:
    width = max(1, texts.dtype.itemsize // 4)
    return texts.view(np.uint32).reshape(len(texts), width)


def _similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = _letters(left), _letters(right)
    la, lb = (a != 0).sum(1), (b != 0).sum(1)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    place = np.arange(b.shape[1])[None, :]
    used_a = np.zeros(a.shape, bool)
    free_b = place < lb[:, None]
    for i in range(a.shape[1]):
        near = free_b & (b == a[:, i:i + 1]) & (np.abs(place - i) <= reach) & (i < la)[:, None]
        row = np.flatnonzero(near.any(1))
        used_a[row, i] = True
        free_b[row, near[row].argmax(1)] = False
    used_b = (place < lb[:, None]) & ~free_b
    m = used_a.sum(1)
    width = min(a.shape[1], b.shape[1])
    first_a = np.take_along_axis(a, np.argsort(~used_a, axis=1, kind="stable"), 1)[:, :width]
    first_b = np.take_along_axis(b, np.argsort(~used_b, axis=1, kind="stable"), 1)[:, :width]
    moved = ((first_a != first_b) & (np.arange(width)[None, :] < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (m / la + m / lb + (m - moved) / m) / 3
    return np.where((la == 0) & (lb == 0), 1.0, np.where(m == 0, 0.0, sim))


def jaro_distances(left, right) -> np.ndarray:
    """1 - Jaro similarity of aligned sequences of texts."""
    left, right = np.asarray(left, dtype=object), np.asarray(right, dtype=object)
    size = np.array([max(len(x), len(y), 1) for x, y in zip(left, right)], dtype=np.int64)
    out = np.empty(len(size))
    order = np.argsort(size, kind="stable")
    done = 0
    while done < len(order):
        # similar lengths together, so one long text does not widen the whole batch
        step = max(1, int(_CELLS // size[order[min(len(order), done + 1) - 1]]))
        chunk = order[done:done + step]
        while len(chunk) > 1 and size[chunk[-1]] * len(chunk) > 2 * _CELLS:
            chunk = chunk[: len(chunk) // 2]
        out[chunk] = 1.0 - _similarity(left[chunk].astype("U"), right[chunk].astype("U"))
        done += len(chunk)
    return out


def jaro_distance(left: str | Column, right: str | Column) -> Column:
    """Plain Jaro distance (no bonus for a common start); both texts must be present."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(jaro_distances(a.to_numpy(), b.to_numpy()))

    return F.pandas_udf(batch, T.DoubleType())(left, right)
