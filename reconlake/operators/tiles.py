"""Neighbourhood filters over pixel tables: square tiles as arrays, each with a rim of its neighbours' pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile, at least; and at least RIMS times the rim, so that a pixel goes to (1 + 2 / RIMS)^2 tiles on average at most.
SIDE, RIMS = 64, 8


def tiled(px: DataFrame, columns: list[str], rim: int, f: Callable[..., tuple[np.ndarray, list[np.ndarray]]], made: str, sample: str = "sample_id") -> DataFrame:
    """(sample, v, u, made): f over each tile of the pixels' columns.

    f(present, *columns) gets arrays with `rim` more pixels on each side, absent ones False, and nulls as NaN (False in boolean columns); it
    returns which pixels of the tile without its rim have a row, and the values of `made` there. A pixel is sent to its own tile and to
    those in whose rim it lies; a task holds one tile.
    """
    side = max(SIDE, RIMS * rim)
    near = lambda c: F.sequence(F.floor((F.col(c) - rim) / side), F.floor((F.col(c) + rim) / side))
    rows = px.select(sample, "v", "u", *columns, F.explode(near("v")).alias("_tv")).withColumn("_tu", F.explode(near("u")))
    kinds = dict(px.dtypes)
    flags = [kinds[c] == "boolean" for c in columns]
    names = [sample, "v", "u", *[x.strip().split(" ")[0] for x in made.split(",") if x.strip()]]

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        top, left = key[1] * side - rim, key[2] * side - rim
        at = tile["v"].to_numpy() - top, tile["u"].to_numpy() - left
        whole = side + 2 * rim
        present = np.zeros((whole, whole), bool)
        present[at] = True
        arrays = []
        for c, flag in zip(columns, flags):
            a = np.zeros((whole, whole), bool) if flag else np.full((whole, whole), np.nan)
            a[at] = tile[c].fillna(False).astype(bool) if flag else tile[c].astype(float)
            arrays.append(a)
        keep, values = f(present, *arrays)
        v, u = np.nonzero(keep)
        return pd.DataFrame(dict(zip(names, [key[0], v + top + rim, u + left + rim, *[x[v, u] for x in values]])), columns=names)

    schema = ", ".join([f"{sample} {kinds[sample]}", f"v {kinds['v']}", f"u {kinds['u']}", *([made] if made else [])])
    return rows.groupBy(sample, "_tv", "_tu").applyInPandas(run, schema)


def inner(a: np.ndarray, rim: int) -> np.ndarray:
    return a[rim : a.shape[0] - rim, rim : a.shape[1] - rim]


def shifted(a: np.ndarray, dv: int, du: int, empty) -> np.ndarray:
    """a where each pixel has the value dv rows below and du columns to its right, `empty` beyond the edge."""
    out = np.full_like(a, empty)
    h, w = a.shape
    out[max(0, -dv) : h - max(0, dv), max(0, -du) : w - max(0, du)] = a[max(0, dv) : h - max(0, -dv), max(0, du) : w - max(0, -du)]
    return out


def eroded(mask: np.ndarray, n: int, outside: bool) -> np.ndarray:
    """n erosions with the four neighbours; beyond the edge counts as `outside`."""
    for _ in range(n):
        mask = mask & np.logical_and.reduce([shifted(mask, dv, du, outside) for dv, du in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    return mask


def extreme(a: np.ndarray, r: int, best: np.ufunc, empty: float) -> np.ndarray:
    """best (np.maximum or np.minimum) of the (2 r + 1)^2 pixels around each, rows first, then columns."""
    for axis in ((1, 0), (0, 1)):
        a = best.reduce([shifted(a, k * axis[0], k * axis[1], empty) for k in range(-r, r + 1)])
    return a


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a normal curve out to four deviations, with sum 1."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def convolved(a: np.ndarray, kernel: list[float]) -> np.ndarray:
    """Sums weighted by a symmetric kernel, rows first, then columns; of meaning where the kernel lies within."""
    r = len(kernel) // 2
    for axis in ((1, 0), (0, 1)):
        a = sum(k * shifted(a, d * axis[0], d * axis[1], 0.0) for d, k in zip(range(-r, r + 1), kernel))
    return a
