"""Pose signals of image tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import camera_center, valid_point, viewing_direction


def with_pose(images: DataFrame, q: str = "qvec", t: str = "tvec") -> DataFrame:
    return images.withColumns({"camera_center": camera_center(F.col(q), F.col(t)), "viewing_direction": viewing_direction(F.col(q))})


def image_poses(images: DataFrame) -> DataFrame:
    """The summary view of an image table: counts instead of 2D points, and the camera's centre."""
    observed = F.size(F.filter("points2d", lambda p: valid_point(p["point3d_id"])))
    return with_pose(images).select("image_id", "qvec", "tvec", "camera_id", "name", F.size("points2d").cast("long").alias("num_points2d"), observed.cast("long").alias("num_observed_points"), "camera_center", "viewing_direction")


def center_scale(df: DataFrame, scene: str, center: str = "camera_center") -> DataFrame:
    """(scene, scale): diagonal of the centres' bounding box; 1 for fewer than two centres or a box of size 0."""
    c = F.col(center)
    box = df.filter(c.isNotNull()).groupBy(scene).agg(F.count("*").alias("n"), *[f(F.get(c, k)).alias(f"{s}{k}") for k in range(3) for f, s in ((F.min, "lo"), (F.max, "hi"))])
    size = F.sqrt(sum(((F.col(f"hi{k}") - F.col(f"lo{k}")) ** 2 for k in range(3)), F.lit(0.0)))
    return df.select(scene).distinct().join(box.select(scene, F.when((F.col("n") < 2) | (size == 0), 1.0).otherwise(size).alias("scale")), scene, "left").select(scene, F.coalesce("scale", F.lit(1.0)).alias("scale"))
