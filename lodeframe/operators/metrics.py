"""Image metrics, means with explicit null and infinity rules, and render lookup."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import json_safe


def nullable_mean(x: Column) -> Column:
    return F.avg(x)


def inf_aware_mean(x: Column) -> Column:
    """Mean of non-null values; infinite if all are infinite, null if only some are, null for none."""
    infinite = F.count_if(F.abs(x) == float("inf"))
    return F.when(infinite == 0, F.avg(x)).when(infinite == F.count(x), F.lit(float("inf")))


def safe_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: json_safe(F.col(c)) for c in columns})


def _box(x: np.ndarray, size: int) -> np.ndarray:
    c = np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / size**2


def ssim(a: np.ndarray, b: np.ndarray, peak: float = 1.0, size: int = 7) -> float:
    """Structural similarity (Wang et al. 2004): uniform windows, sample covariance, mean over windows inside the image and over channels."""
    if a.shape != b.shape:
        raise ValueError("images of different shapes")
    if min(a.shape[:2]) < size:
        raise ValueError(f"images under {size} pixels")
    a, b = (np.atleast_3d(x.astype(np.float64)) for x in (a, b))
    c1, c2, n = (0.01 * peak) ** 2, (0.03 * peak) ** 2, size * size
    out = []
    for k in range(a.shape[2]):
        x, y = a[..., k], b[..., k]
        mx, my = _box(x, size), _box(y, size)
        f = n / (n - 1)
        vx, vy, cov = f * (_box(x * x, size) - mx * mx), f * (_box(y * y, size) - my * my), f * (_box(x * y, size) - mx * my)
        out.append(float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean()))
    return float(np.mean(out))


def ssim_column(height: int, width: int, peak: float = 1.0):
    """A vectorised function of two array columns (row-major, one channel)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ssim(np.asarray(x, float).reshape(height, width), np.asarray(y, float).reshape(height, width), peak) for x, y in zip(a, b, strict=True)], dtype=float)

    return run


def ssim_window(a: Column, b: Column, peak: float = 1.0) -> Column:
    """Structural similarity of two arrays as a single window, in SQL expressions."""
    n = F.size(a)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def product(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda u, v: u.cast("double") * v)

    ma, mb = total(a) / n, total(b) / n
    va, vb, cov = ((total(product(x, y)) - n * m1 * m2) / (n - 1) for x, y, m1, m2 in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def render_lookup(truth: DataFrame, renders: DataFrame, scene: str) -> DataFrame:
    """truth (scene, name, position) with render_name: the same name, else the stem with .png, .jpg or .jpeg, else the position as five digits
    with .png, the first that exists; null where none does."""
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    keys = F.array(F.col("name"), F.concat(stem, F.lit(".png")), F.concat(stem, F.lit(".jpg")), F.concat(stem, F.lit(".jpeg")), F.format_string("%05d.png", F.col("position").cast("int")))
    tried = truth.select(scene, "name", "position", F.posexplode(keys).alias("priority", "render_name"))
    found = tried.join(renders.select(scene, F.col("name").alias("render_name")).distinct(), [scene, "render_name"])
    best = found.groupBy(scene, "name", "position").agg(F.min_by("render_name", "priority").alias("render_name"))
    return truth.select(scene, "name", "position").join(best, [scene, "name", "position"], "left")
