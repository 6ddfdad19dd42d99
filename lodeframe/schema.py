"""Schemas of the tables that operators exchange, and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

POINT2D = "struct<x: double, y: double, point3d_id: bigint>"
CAMERA = "camera_id int, model string, width bigint, height bigint, params array<double>"
IMAGE = f"image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<{POINT2D}>"
POINT3D = "point3d_id bigint, xyz array<double>, rgb array<smallint>, error double, track array<struct<image_id: int, point2d_idx: int>>"
FRAME_QUALITY = (
    "frame_id bigint, source_frame_index bigint, filename string, timestamp_seconds double, blur_score double, mean_brightness double, dark_pixel_ratio double, "
    "bright_pixel_ratio double, feature_count bigint, match_count bigint, similarity_score double, selected boolean, selection_reason string"
)
METRIC = "image_name string, render_name string, psnr double, ssim double, lpips double"
RESULT = (
    "experiment string, selection_method string, training_budget bigint, train_image_count bigint, test_image_count bigint, iterations bigint, gpu string, "
    "training_runtime_seconds double, render_runtime_seconds double, initial_loss double, final_loss double, number_of_gaussians bigint, psnr double, ssim double, "
    "lpips double, checkpoint_path string, point_cloud_path string, render_path string, status string, warnings array<string>"
)
MANIFEST = (
    "experiment_name string, selection_method string, training_budget bigint, training_images array<string>, test_images array<string>, train_image_count bigint, "
    "test_image_count bigint, total_scene_images bigint"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def names(ddl: str) -> list[str]:
    """Column names of a schema of plain columns, without a session."""
    return [x.split()[0] for x in ddl.split(", ")]


#: Camera models by id with their parameter counts.
CAMERA_MODELS = (
    ("SIMPLE_PINHOLE", 3),
    ("PINHOLE", 4),
    ("SIMPLE_RADIAL", 4),
    ("RADIAL", 5),
    ("OPENCV", 8),
    ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12),
    ("FOV", 5),
    ("SIMPLE_RADIAL_FISHEYE", 4),
    ("RADIAL_FISHEYE", 5),
    ("THIN_PRISM_FISHEYE", 12),
)
#: Image suffixes, reasons of a quality class, states of a result, selection weights, the least usable score, the id of no point.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
REASONS = ("invalid_image", "blur", "underexposed", "overexposed", "redundant", "selected")
STATUSES = ("not_run", "success", "failed")
WEIGHTS = {"pose_diversity": 0.65, "quality": 0.25, "features": 0.10}
MIN_QUALITY_SCORE = 0.35
MISSING_POINT = -1
