"""Reconstruction models as three tables: the induced sub-model and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import valid_point


@dataclass
class Model:
    """camera, image and point3d tables (schema module)."""

    cameras: DataFrame
    images: DataFrame
    points: DataFrame


def filter_tracks(tracks: DataFrame, images: DataFrame, point: str, image: str, min_track_length: int = 1) -> DataFrame:
    """(point, track_length) of points with enough track entries on the chosen images. tracks: a row for each entry; repeated entries count."""
    kept = tracks.join(images.select(image).distinct(), image, "left_semi")
    return kept.groupBy(point).agg(F.count("*").alias("track_length")).filter(F.col("track_length") >= min_track_length)


def relink(points2d: DataFrame, surviving: DataFrame, point: str) -> DataFrame:
    """points2d with -1 for points that did not survive; every row stays."""
    alive = surviving.select(F.col(point), F.lit(True).alias("__alive")).distinct()
    return points2d.join(alive, point, "left").withColumn(point, F.when(F.col("__alive"), F.col(point)).otherwise(F.lit(-1))).drop("__alive")


def used_cameras(cameras: DataFrame, images: DataFrame, camera: str = "camera_id") -> DataFrame:
    """The cameras of some images."""
    return cameras.join(images.select(camera).distinct(), camera, "left_semi")


def named_images(images: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The images with these names; a name that no image has fails when the plan runs."""
    wanted = names.select(F.col(name).alias("name")).distinct()
    found = wanted.join(images.withColumn("__there", F.lit(True)), "name", "left")
    unknown = F.raise_error(F.concat(F.lit("an image that the model lacks: "), F.coalesce("name", F.lit("null"))))
    return found.filter(F.when(F.col("__there"), True).otherwise(unknown.cast("boolean"))).select(*images.columns)


def filter_model(model: Model, names: DataFrame, min_track_length: int = 1, name: str = "name") -> Model:
    """The sub-model of the named images: poses and intrinsics as they are, tracks cut to these images, points with too short a track gone,
    2D points kept with -1 where their point is gone. Unknown names fail when the plan runs; no names give an empty model.

    No action runs here. The 2D points and the tracks are exploded once each, with the columns that they are joined on.
    """
    images = named_images(model.images, names, name)
    ids = images.select("image_id")
    entry = F.struct("k", "e.image_id", "e.point2d_idx")
    kept = model.points.select("point3d_id", F.posexplode("track").alias("k", "e")).withColumn("image_id", F.col("e.image_id")).join(ids, "image_id", "left_semi")
    kept = kept.groupBy("point3d_id").agg(F.array_sort(F.collect_list(entry)).alias("t")).filter(F.size("t") >= min_track_length)
    kept = kept.select("point3d_id", F.transform("t", lambda e: F.struct(e["image_id"].alias("image_id"), e["point2d_idx"].alias("point2d_idx"))).alias("track"))
    points = model.points.drop("track").join(kept, "point3d_id")
    # only the places whose point is gone are joined back
    linked = images.select("image_id", F.explode(F.array_distinct(F.transform("points2d", lambda p: p["point3d_id"]))).alias("point3d_id"))
    alive = linked.join(kept.select("point3d_id"), "point3d_id", "left_semi").groupBy("image_id").agg(F.collect_list("point3d_id").alias("alive"))
    columns = model.images.columns
    cut = F.transform("points2d", lambda p: F.when(F.array_contains(F.coalesce("alive", F.array().cast("array<bigint>")), p["point3d_id"]), p).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(-1).cast("long").alias("point3d_id"))))
    images = images.join(alive, "image_id", "left").withColumn("points2d", cut).select(*columns)
    return Model(used_cameras(model.cameras, images), images, points.select(*model.points.columns))


def model_summary(model: Model, total_images: int | None = None) -> DataFrame:
    """One row: numbers of cameras, images, points and observations, sorted camera models, and the share of registered images."""
    c = model.cameras.agg(F.count("*").alias("number_of_cameras"), F.array_sort(F.collect_set("model")).alias("camera_models"))
    seen = F.size(F.filter("points2d", lambda p: valid_point(p["point3d_id"])))
    i = model.images.agg(F.count("*").alias("registered_images"), F.coalesce(F.sum(seen), F.lit(0)).alias("from_images"))
    p = model.points.agg(F.count("*").alias("number_of_sparse_points"), F.coalesce(F.sum(F.size("track")), F.lit(0)).alias("from_points"))
    total = F.col("registered_images") if total_images is None else F.lit(total_images).cast("long")
    out = c.crossJoin(i).crossJoin(p).withColumn("total_images", total)
    return out.select(
        "number_of_cameras", "camera_models", "total_images", "registered_images", F.try_divide("registered_images", "total_images").alias("registration_rate"), "number_of_sparse_points",
        F.coalesce(F.nullif(F.col("from_points"), F.lit(0)), F.col("from_images")).alias("number_of_observations"),
    )


def samples(df: DataFrame, key: str, count: int = 10) -> DataFrame:
    return df.orderBy(key).limit(count)


def best_model(models: DataFrame, by: str | None = None, model: str = "model_id", registered: str = "registered_images") -> DataFrame:
    """The model with the most registered images, the first of equals."""
    best = F.max_by(F.struct(model, registered), F.struct(F.col(registered), -F.col(model)))
    return models.groupBy(*([by] if by else [])).agg(best.alias("m")).select(*([by] if by else []), "m.*")
