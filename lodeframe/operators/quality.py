"""Quality classes, gates and pixel statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MIN_QUALITY_SCORE


def quality_gate(df: DataFrame, reason: str = "selection_reason") -> DataFrame:
    return df.filter(F.col(reason) == "selected")


def usable(df: DataFrame, scene: str, budget: int, valid: str = "valid", score: str = "score", minimum: float = MIN_QUALITY_SCORE, strict: bool = False) -> DataFrame:
    """Valid rows that score at least `minimum`; a scene with fewer than `budget` of them keeps all its valid rows, and with fewer of those is an error if strict."""
    good = F.col(valid) & (F.col(score) >= minimum)
    counts = df.groupBy(scene).agg(F.count_if(good).alias("__good"), F.count_if(F.col(valid)).alias("__valid"))
    rows = df.join(counts.withColumnRenamed(scene, "__scene"), F.col(scene).eqNullSafe(F.col("__scene")))
    keep = F.when(F.col("__good") >= budget, good).otherwise(F.col(valid))
    if strict:
        keep = F.when(F.col("__valid") < budget, F.raise_error(F.lit("too few valid rows for the budget"))).otherwise(keep)
    return rows.filter(keep).select(*df.columns)


def selection_summary(df: DataFrame, by: list[str] | None = None, reason: str = "selection_reason") -> DataFrame:
    """Rows, rejections by reason, and retained rows."""
    counts = [F.count_if(F.col(reason) == x).alias(name) for x, name in (("invalid_image", "rejected_invalid"), ("blur", "rejected_blur"), ("underexposed", "rejected_underexposed"), ("overexposed", "rejected_overexposed"), ("redundant", "rejected_redundant"), ("selected", "retained"))]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *counts)


def signal_counts(df: DataFrame, by: list[str] | None = None, blur: str = "blur_score", center: str | None = "camera_center", features: str | None = None) -> DataFrame:
    """Rows, and rows that have each signal."""
    signals = {"quality_signal_count": blur, "pose_signal_count": center, "feature_signal_count": features}
    return df.groupBy(*(by or [])).agg(F.count("*").alias("candidate_count"), *[F.count(c).alias(name) for name, c in signals.items() if c])


def join_quality(poses: DataFrame, signals: DataFrame, keys: list[str], defaults: dict, observed: str = "num_observed_points") -> DataFrame:
    """poses with their quality signals, or with `defaults` (by column) where they have none. Where feature_count is missing, the number of observed points stands in if it is positive."""
    there = signals.select(*keys, *defaults, F.lit(True).alias("__there"))
    out = poses.join(there, keys, "left").withColumns({c: F.when(F.col("__there"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("__there")
    if "feature_count" in defaults and observed in poses.columns:
        out = out.withColumn("feature_count", F.coalesce("feature_count", F.when(F.col(observed) > 0, F.col(observed))))
    return out


def brightness_stats(pixels: Column, dark: float = 30, bright: float = 225) -> Column:
    """Struct of mean, share at or under the dark cutoff, share at or over the bright cutoff; null for no pixels."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n > 0, F.struct(mean.alias("mean"), (F.size(F.filter(pixels, lambda x: x <= dark)) / n).alias("dark"), (F.size(F.filter(pixels, lambda x: x >= bright)) / n).alias("bright")))


def laplacian_variance(pixels: Column, width: int, height: int) -> Column:
    """Population variance of the cross-shaped Laplacian of a small image (row-major array), borders mirrored without repeating the edge."""

    def at(row: int, col: int) -> Column:
        row = -row if row < 0 else 2 * height - 2 - row if row >= height else row
        col = -col if col < 0 else 2 * width - 2 - col if col >= width else col
        return F.get(pixels, row * width + col)

    edges = F.array(*[at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c) for r in range(height) for c in range(width)])
    n = width * height
    mean = F.aggregate(edges, F.lit(0.0), lambda s, x: s + x) / n
    return F.transform(F.array(F.struct(edges.alias("e"), mean.alias("m"))), lambda p: F.aggregate(p["e"], F.lit(0.0), lambda s, x: s + (x - p["m"]) * (x - p["m"])) / n)[0]


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of an 8-bit BGR image, rounded to 8 bits."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def image_statistics(bgr: np.ndarray, dark: int = 30, bright: int = 225) -> tuple[float, float, float, float]:
    """Laplacian variance, mean, dark share and bright share of one image."""
    g = gray(bgr)
    p = np.pad(g.astype(np.float64), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, mode="edge")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(edges.var()), float(g.mean()), float((g <= dark).mean()), float((g >= bright).mean())


STATISTICS = ["blur_score", "mean_brightness", "dark_pixel_ratio", "bright_pixel_ratio"]
