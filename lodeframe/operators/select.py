"""Greedy selection of diverse, good images under a budget."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import feature_score, quality_score
from ..schema import MIN_QUALITY_SCORE, WEIGHTS
from .quality import usable


def normalised_weights(overrides: dict[str, float] | None = None) -> tuple[float, float, float]:
    merged = WEIGHTS | (overrides or {})
    total = sum(merged.values())
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return tuple(merged[k] / total for k in ("pose_diversity", "quality", "features"))


def greedy(centers: np.ndarray, directions: np.ndarray, order: np.ndarray, quality: np.ndarray, features: np.ndarray, budget: int, sequence: float, weights: tuple[float, float, float]) -> list[int]:
    """Places (in scene order) of the chosen rows. Rows are in scene order; missing poses are not-a-number.

    Starts from both ends and adds the row with the greatest weighted sum of its least distance to the chosen ones, its quality and its features;
    the first of equals. Least distances are kept up to date, so a round costs one distance a row.
    """
    n = len(order)
    if budget >= n:
        return list(range(n))
    if budget == 1:
        return [max(range(n), key=lambda k: (quality[k], -order[k]))]
    there = ~np.isnan(centers).any(1)
    scale = 1.0
    if there.sum() >= 2:
        scale = math.sqrt(float(((centers[there].max(0) - centers[there].min(0)) ** 2).sum())) or 1.0

    def distance(k: int) -> np.ndarray:
        d = centers - centers[k]
        gap = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2)
        dot = directions[:, 0] * directions[k, 0] + directions[:, 1] * directions[k, 1] + directions[:, 2] * directions[k, 2]
        turn = np.arccos(np.clip(dot, -1.0, 1.0)) / math.pi
        return np.nan_to_num(0.55 * np.minimum(1.0, gap / scale)) + np.nan_to_num(0.30 * turn) + 0.15 * np.abs(order - order[k]) / max(1.0, sequence)

    chosen = [0, n - 1]
    least = np.minimum(distance(0), distance(n - 1))
    taken = np.zeros(n, bool)
    taken[chosen] = True
    while len(chosen) < budget:
        total = np.where(taken, -np.inf, weights[0] * least + weights[1] * quality + weights[2] * features)
        k = int(np.argmax(total))
        chosen.append(k)
        taken[k] = True
        least = np.minimum(least, distance(k))
    return sorted(chosen)


def greedy_selection(candidates: DataFrame, scene: str, budget: int, minimum: float = MIN_QUALITY_SCORE, weights: dict[str, float] | None = None, strict: bool = True) -> DataFrame:
    """The chosen rows of each scene. candidates: scene, name, order_index, camera_center, viewing_direction (arrays or null), valid, blur_score,
    mean_brightness, dark_pixel_ratio, bright_pixel_ratio, feature_count.

    Quality and features are scored in SQL, thin scenes fall back to all valid rows, and each scene is then chosen from in one task.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    w = normalised_weights(weights)
    v = F.col("valid")
    last = candidates.groupBy(scene).agg(F.max("order_index").alias("__sequence"))
    scored = candidates.withColumns({"score": quality_score(v, F.col("blur_score"), F.col("mean_brightness"), F.col("dark_pixel_ratio"), F.col("bright_pixel_ratio")), "feature": feature_score(v, F.col("feature_count"))})
    rows = usable(scored, scene, budget, minimum=minimum, strict=strict).join(last, scene)
    rows = rows.select(scene, "name", "order_index", "camera_center", "viewing_direction", "score", "feature", "__sequence")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order_index", kind="stable").reset_index(drop=True)
        nowhere = [math.nan] * 3
        c, d = (np.array([nowhere if x is None else list(x) for x in part[col]], float) for col in ("camera_center", "viewing_direction"))
        k = greedy(c, d, part["order_index"].to_numpy(float), part["score"].to_numpy(float), part["feature"].to_numpy(float), budget, float(part["__sequence"].iloc[0]), w)
        return part.loc[k, [scene, "name", "order_index"]]

    kinds = dict(candidates.dtypes)
    return rows.groupBy(scene).applyInPandas(choose, f"{scene} {kinds[scene]}, name {kinds['name']}, order_index {kinds['order_index']}")


#: The name that results give the selection (a fixed value).
ALGORITHM = "quality_filtered_greedy_pose_coverage"


def diagnostics(candidates: DataFrame, scene: str, budget: int, minimum: float = MIN_QUALITY_SCORE, weights: dict[str, float] | None = None) -> DataFrame:
    """What greedy_selection has to choose from in each scene: algorithm, budget, candidates, usable ones, whether the quality filter holds, its minimum, the weights, and how many candidates have each signal."""
    v = F.col("valid")
    good = v & (quality_score(v, F.col("blur_score"), F.col("mean_brightness"), F.col("dark_pixel_ratio"), F.col("bright_pixel_ratio")) >= minimum)
    enough = F.count_if(good) >= budget
    shares = dict(zip(("pose_diversity", "image_quality", "feature_richness"), normalised_weights(weights), strict=True))
    return candidates.groupBy(scene).agg(
        F.lit(ALGORITHM).alias("algorithm"), F.lit(budget).cast("long").alias("budget"), F.count("*").alias("candidate_count"), F.when(enough, F.count_if(good)).otherwise(F.count_if(v)).alias("usable_candidate_count"), enough.alias("quality_filter_used"),
        F.lit(float(minimum)).alias("min_quality_score"), F.create_map(*[x for k, w in shares.items() for x in (F.lit(k), F.lit(w))]).alias("weights"), F.count("blur_score").alias("quality_signal_count"), F.count("camera_center").alias("pose_signal_count"),
    )


def best_single(scored: DataFrame, scene: str, name: str = "name", score: str = "score", order: str = "order_index") -> DataFrame:
    """The best row of each scene, the first of equals: what a budget of 1 chooses."""
    return scored.groupBy(scene).agg(F.max_by(name, F.struct(F.col(score), -F.col(order))).alias(name))
