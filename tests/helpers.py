"""Small rasters and brute-force versions of the operators, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def raster(spark, masks: dict[str, np.ndarray], column: str = "mask"):
    """A pixel table (aoi_id, row, col, <column>) of several 2-D arrays."""
    rows = [
        (aoi, r, c, int(m[r, c]))
        for aoi, m in masks.items()
        for r in range(m.shape[0])
        for c in range(m.shape[1])
    ]
    return spark.createDataFrame(rows, f"aoi_id string, row bigint, col bigint, {column} int")


def grid(df, shape, column: str = "mask", aoi: str | None = None) -> np.ndarray:
    """A pixel table back as a 2-D array; fails on missing or repeated pixels."""
    df = df if aoi is None else df.where(F.col("aoi_id") == aoi)
    rows = df.select("row", "col", column).collect()
    assert len(rows) == shape[0] * shape[1]
    out = np.full(shape, -1)
    for r, c, v in rows:
        out[r, c] = v
    assert (out >= 0).all()
    return out


def neighbourhood(mask: np.ndarray, n: int, pick) -> np.ndarray:
    h = n // 2
    out = np.empty_like(mask)
    for r in range(mask.shape[0]):
        for c in range(mask.shape[1]):
            out[r, c] = pick(mask[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1])
    return out


def erode(mask, n):
    return neighbourhood(mask, n, np.min)


def dilate(mask, n):
    return neighbourhood(mask, n, np.max)


def opened(mask, n):
    return dilate(erode(mask, n), n)


def closed(mask, n):
    return erode(dilate(mask, n), n)


def cleaned(mask, n):
    return closed(opened(mask, n), n)


def inside(ring, x, y) -> bool:
    """Even-odd test, half-open in y."""
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit
