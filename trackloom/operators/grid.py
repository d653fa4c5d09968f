"""Small grids: heat maps, their components, and weighted means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """8-connected components of a grid, in order of their first cell: cells, x0, y0, x1, y1."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    while True:
        wide = np.pad(label, 1)
        views = [wide[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)]
        low = np.min([np.where(v > 0, v, mask.size + 1) for v in views], axis=0)
        following = np.where(mask, np.minimum(label, low), 0)
        if (following == label).all():
            break
        label = following
    out = []
    for k in np.unique(label[label > 0]):
        y, x = np.nonzero(label == k)
        out.append((len(x), int(x.min()), int(y.min()), int(x.max()), int(y.max())))
    return out


def decode_heatmap(cells: Column, width: int, height: int, threshold: float, out_width: float, out_height: float) -> Column:
    """Point of a row-major grid: centre of the box of the largest component over the threshold.

    Of equal components the one whose first cell comes first; none gives (0, 0).
    A point that is not (0, 0) is visible.
    """

    @F.pandas_udf("cells long, x double, y double, visible boolean")
    def decode(grids: pd.Series) -> pd.DataFrame:
        rows = []
        for g in grids:
            found = components(np.asarray(g, float).reshape(height, width) > threshold) if g is not None and len(g) == width * height else []
            if found:
                n, x0, y0, x1, y1 = max(found, key=lambda c: c[0])
                x, y = (x0 + x1 + 1) / 2 * out_width / width, (y0 + y1 + 1) / 2 * out_height / height
            else:
                n, x, y = 0, 0.0, 0.0
            rows.append((n, x, y, bool(x or y)))
        return pd.DataFrame(rows, columns=["cells", "x", "y", "visible"])

    return decode(cells)


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of a value by weight within keys."""
    return rows.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value))


def resize_bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize on half-pixel centres with clamped borders, rounded once to even."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    grid = image.astype(float)
    fx = fx.reshape(1, -1, *([1] * (image.ndim - 2)))
    fy = fy.reshape(-1, 1, *([1] * (image.ndim - 2)))
    rows = grid[:, x0] * (1 - fx) + grid[:, x1] * fx
    return np.rint(rows[y0] * (1 - fy) + rows[y1] * fy).astype(image.dtype)


def model_input(frames: list[np.ndarray], background: np.ndarray, width: int, height: int) -> np.ndarray:
    """Planes of a model: background first, then frames, each RGB, resized, scaled to 0..1."""
    planes = [np.moveaxis(resize_bilinear(f[..., ::-1], width, height), 2, 0) for f in (background, *frames)]
    return np.concatenate(planes).astype(np.float32) / 255


def model_input_column(images: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Arrays of images (row-major BGR bytes, the background first) as one flat array of planes; null where an image has another size."""

    @F.pandas_udf("array<float>")
    def planes(rows: pd.Series) -> pd.Series:
        def one(row) -> np.ndarray | None:
            if row is None or any(i is None or len(i) != width * height * 3 for i in row):
                return None
            first, *rest = (np.asarray(i, np.uint8).reshape(height, width, 3) for i in row)
            return model_input(rest, first, to_width, to_height).reshape(-1)

        return rows.map(one)

    return planes(images)


def predict(windows: DataFrame, run, schema: str) -> DataFrame:
    """Stage of a model: ``run`` maps batches of windows (pandas) to rows; made once for each worker's batches."""

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield run(batch)

    return windows.mapInPandas(stage, schema)


def resize_column(cells: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Row-major grids of whole numbers, resized; a grid of another size gives null."""

    @F.pandas_udf("array<int>")
    def resize(grids: pd.Series) -> pd.Series:
        fit = lambda g: g is not None and len(g) == width * height
        return grids.map(lambda g: resize_bilinear(np.asarray(g, np.int64).reshape(height, width), to_width, to_height).reshape(-1) if fit(g) else None)

    return resize(cells)

