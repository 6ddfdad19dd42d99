"""Composite plans: frame analysis, frame comparison, held-out evaluation, manifests, scene preparation, reconstruction summary."""

from __future__ import annotations

import json
import os
import shutil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import motion_penalty, psnr, quality_class, redundant, similarity
from ..operators import features, sampling, select, submodel
from ..operators.metrics import inf_aware_mean, nullable_mean, render_lookup, ssim_column
from ..operators.pixels import rgb
from ..operators.quality import STATISTICS, gray, image_statistics
from ..operators.results import write_csv
from ..operators.validation import enforce, manifest_violations, overlap, selection_violations
from ..schema import FRAME_QUALITY, MANIFEST, METRIC, struct
from ..sources import paths
from ..sources.sfm import record_count, write_model


def _analysis(dark: int, bright: int, maximum: int):
    """A vectorised function of the image source's columns: pixel statistics, and corners with their descriptors (at most `maximum`; 0: none are looked for). Null for undecodable images."""
    points, bits = "array<array<double>>", "array<array<bigint>>"

    @F.pandas_udf(", ".join(f"{c} double" for c in STATISTICS) + f", feature_count bigint, points {points}, descriptors {bits}")
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, c, raw in zip(height, width, channels, data, strict=True):
            if h is None or h <= 0 or raw is None:
                out.append((None,) * 7)
                continue
            bgr = rgb(h, w, c, raw)[..., ::-1]
            found = features.detect(gray(bgr), maximum)
            out.append((*image_statistics(bgr, dark, bright), len(found[0]) if maximum else None, found[0].tolist(), found[1].view(np.int64).tolist()))
        table = pd.DataFrame(out, columns=[*STATISTICS, "feature_count", "points", "descriptors"])
        return table.astype({c: float for c in STATISTICS} | {"feature_count": "Int64"})

    return run


def analyse_frames(images: DataFrame, dark_cutoff: int = 30, bright_cutoff: int = 225, maximum_features: int = 0, **thresholds) -> DataFrame:
    """Decoded images (the image source's columns and any others) with their pixel statistics, feature_count, points, descriptors and quality class."""
    pixels = ("height", "width", "nChannels", "data")
    others = [c for c in images.columns if c not in (*pixels, "mode")]
    out = images.withColumn("__s", _analysis(dark_cutoff, bright_cutoff, maximum_features)(*pixels))
    out = out.select(*others, *[F.when(F.col("height") > 0, F.col(c)).alias(c) for c in ("height", "width")], "__s.*")
    reason = quality_class(F.col("blur_score"), F.col("mean_brightness"), F.col("dark_pixel_ratio"), F.col("bright_pixel_ratio"), **thresholds)
    return out.withColumn("selection_reason", reason).withColumn("selected", F.col("selection_reason") == "selected")


def select_distinct(analysed: DataFrame, group: str, order: str, name: Column | str = "origin", rules: features.Rules | None = None) -> DataFrame:
    """FRAME_QUALITY rows (with the group) of analysed frames: each passing frame is held against the latest kept one of its group by matched features, and goes as redundant where
    they are alike. A group's frames, without their pixels, are one task's work, as each decision depends on the one before."""
    rules = rules or features.Rules()
    given = dict(analysed.dtypes)
    listed = [f.name for f in struct(FRAME_QUALITY).fields]
    named = F.col(name) if isinstance(name, str) else name
    nothing = {"frame_id": "bigint", "source_frame_index": "bigint", "timestamp_seconds": "double"}
    rows = analysed.select(
        group, F.col(order).alias("__order"), F.element_at(F.split(named, "/"), -1).alias("filename"), *STATISTICS, "feature_count", "selected", "selection_reason", "height", "width", "points", "descriptors",
        *[(F.col(c) if c in given else F.lit(None).cast(t)).alias(c) for c, t in nothing.items()],
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__order", "filename"], kind="stable").reset_index(drop=True)
        match_count, score = [pd.NA] * len(part), [np.nan] * len(part)
        last = None
        for k, row in enumerate(part.itertuples(index=False)):
            if not row.selected:
                continue
            own = (np.array([list(x) for x in row.points], float).reshape(-1, 2), np.array([list(x) for x in row.descriptors], np.int64).reshape(-1, 4).view(np.uint64))
            if last is not None:
                found = features.compare(last, own, (row.height, row.width), rules)
                match_count[k], score[k] = found.match_count, np.nan if found.similarity_score is None else found.similarity_score
                if found.redundant:
                    part.at[k, "selected"], part.at[k, "selection_reason"] = False, "redundant"
                    continue
            last = own
        numbered = part["frame_id"].astype("Int64").fillna(pd.Series(range(1, len(part) + 1), dtype="Int64"))
        part = part.assign(match_count=pd.array(match_count, dtype="Int64"), similarity_score=score, frame_id=numbered)
        return part[[group, *listed]]

    return rows.groupBy(group).applyInPandas(run, f"`{group}` {given[group]}, {FRAME_QUALITY}")


def write_frame_quality(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """The 13 columns of FRAME_QUALITY as CSV, in frame order; nulls are empty cells, truth values True and False."""
    columns = [f.name for f in struct(FRAME_QUALITY).fields]
    shown = frames.select(*columns).orderBy("frame_id").withColumn("selected", F.when(F.col("selected"), "True").when(~F.col("selected"), "False"))
    write_csv(shown, path, overwrite)


def write_view_metrics(metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    """The columns of METRIC as CSV, by image name; infinite values are written as inf."""
    finite = {c: F.when(F.col(c) == float("inf"), "inf").otherwise(F.col(c).cast("string")) for c in ("psnr", "ssim", "lpips")}
    write_csv(metrics.select(*[f.name for f in struct(METRIC).fields]).orderBy("image_name").withColumns(finite), path, overwrite)


def compare_frames(pairs: DataFrame, min_features: int = 40, min_matches: int = 50, threshold: float = 0.85, max_motion: float = 0.015) -> DataFrame:
    """pairs (na, nb, matches, motion, inliers) with similarity and redundant. A side with too few features compares with nothing; no matches are similarity 0."""
    reliable = F.coalesce("inliers", "matches")
    score = F.when(F.col("matches") == 0, 0.0).otherwise(similarity(reliable, F.col("na"), F.col("nb"), motion_penalty(F.col("motion"), max_motion)))
    poor = (F.col("na") < min_features) | (F.col("nb") < min_features)
    out = pairs.withColumn("similarity", F.when(~poor, score)).withColumn("matches", F.when(poor, 0).otherwise(F.col("matches")))
    return out.withColumn("redundant", F.coalesce(redundant(F.col("matches"), F.col("similarity"), F.col("motion"), min_matches, threshold, max_motion), F.lit(False)) & ~poor)


def evaluate_views(truth: DataFrame, renders: DataFrame, scene: str, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(per image, means) of held-out views. truth: scene, name, position, pixels; renders: scene, name, pixels (row-major, 0 to 1). A view without a render is an error."""
    found = render_lookup(truth, renders, scene)
    enforce(found.filter("render_name is null").select(scene, "name"), "views without a render")
    both = found.join(truth.select(scene, "name", F.col("pixels").alias("a")), [scene, "name"]).join(renders.select(scene, F.col("name").alias("render_name"), F.col("pixels").alias("b")), [scene, "render_name"])
    each = both.select(scene, F.col("name").alias("image_name"), "render_name", psnr(F.col("a"), F.col("b")).alias("psnr"), ssim_column(height, width)("a", "b").alias("ssim"), F.lit(None).cast("double").alias("lpips"))
    means = each.groupBy(scene).agg(F.count("*").alias("images"), inf_aware_mean(F.col("psnr")).alias("psnr_mean"), nullable_mean(F.col("ssim")).alias("ssim_mean"), nullable_mean(F.col("lpips")).alias("lpips_mean"))
    return each, means


def experiment_specs(fixed: list[int] = (30, 60, 100), automatic: int | None = 60, full: bool = False) -> dict[str, tuple[str, int | None]]:
    out: dict[str, tuple[str, int | None]] = {f"fixed_{n}": ("fixed_uniform", n) for n in fixed}
    if automatic:
        out[f"automatic_{automatic}"] = ("automatic_quality_pose", automatic)
    return out | ({"full": ("all_training_candidates", None)} if full else {})


def build_manifests(images: DataFrame, specs: dict[str, tuple[str, int | None]], scene: str = "scene", name: str = "name", interval: int = 8, offset: int = 0, candidates: DataFrame | None = None, quality_status: str | None = None) -> DataFrame:
    """One manifest a scene and experiment. images: scene and name, in name order; candidates: what greedy_selection needs, for automatic experiments.

    Without candidates automatic experiments are left out. Every selection is held against the candidates and its budget. An automatic manifest's quality_status says where its quality signals come
    from: computed, not_requested, or unavailable with a reason (default: computed where any candidate has one).
    """
    split = sampling.heldout_split(images, scene, name, interval, offset)
    train = sampling.training_candidates(split)
    enforce(overlap(train, split.filter("is_test"), [scene, name]), "training and test overlap")
    test = split.filter("is_test").groupBy(scene).agg(F.array_sort(F.collect_list(F.col(name))).alias("test_images"))
    totals = split.groupBy(scene).agg(F.count("*").alias("total_scene_images"))
    parts = []
    for experiment, (method, budget) in specs.items():
        status = F.lit(None).cast("string")
        if method == "automatic_quality_pose":
            if candidates is None:
                continue
            chosen = select.greedy_selection(candidates.join(train.select(scene, F.col(name).alias("name")), [scene, "name"], "left_semi"), scene, budget).select(scene, F.col("name").alias(name))
            status = F.lit(quality_status or ("computed" if not candidates.filter("blur_score is not null").isEmpty() else "not_requested"))
        elif method == "fixed_uniform":
            chosen = sampling.fixed_budget(split, scene, budget)
        else:
            chosen = train
        if budget is not None:
            enforce(selection_violations(chosen, train, [scene, name], scene, budget), f"selection of {experiment}")
        lists = chosen.groupBy(scene).agg(F.array_sort(F.collect_list(F.col(name))).alias("training_images"))
        wanted = F.lit(budget).cast("long") if budget is not None else F.size("training_images").cast("long")
        parts.append(lists.select(scene, F.lit(experiment).alias("experiment_name"), F.lit(method).alias("selection_method"), wanted.alias("training_budget"), "training_images", status.alias("quality_status")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out = out.join(test, scene).join(totals, scene)
    out = out.withColumns({"train_image_count": F.size("training_images").cast("long"), "test_image_count": F.size("test_images").cast("long")})
    enforce(manifest_violations(out), "manifest")
    return out


def write_manifests(manifests: DataFrame, folder: str, scene: str = "scene") -> list[str]:
    """A JSON file for each manifest, in a folder for each scene, after the manifest rules; the paths. Manifests are lists of names of one scene and fetched one by one."""
    enforce(manifest_violations(manifests), "manifest")
    out = []
    for row in manifests.orderBy(scene, "experiment_name").toLocalIterator():
        data = {k: v for k, v in row.asDict().items() if k != scene}
        out.append(paths.joined(folder, str(row[scene]), f"{row['experiment_name']}.json"))
        write_json(out[-1], data)
    return out


def check_manifest(spark: SparkSession, manifest: dict) -> None:
    """The manifest rules for one manifest."""
    columns = struct(MANIFEST)
    if lacking := [f.name for f in columns.fields if f.name not in manifest and f.name != "training_budget"]:
        raise ValueError(f"a manifest without {', '.join(lacking)}")
    enforce(manifest_violations(spark.createDataFrame([tuple(manifest.get(f.name) for f in columns.fields)], columns)), "manifest")


def write_json(path: str, data) -> None:
    """Pretty JSON with sorted keys, replaced at once."""
    paths.write_bytes(path, (json.dumps(data, indent=2, sort_keys=True) + "\n").encode())


def fresh_folder(path: str, overwrite: bool = False) -> None:
    """An empty folder; one with files is an error unless overwrite, which removes it."""
    if os.path.isdir(path) and os.listdir(path):
        if not overwrite:
            raise FileExistsError(path)
        shutil.rmtree(path)
    os.makedirs(path, exist_ok=True)


def link_images(sources: dict[str, str], target: str, mode: str = "hardlink") -> str:
    """Links files into target, copying where a link can't be made; the mode that was used, or mixed."""
    if mode not in ("hardlink", "symlink", "copy"):
        raise ValueError(mode)
    os.makedirs(target, exist_ok=True)
    used = set()
    for name, source in sources.items():
        goal = os.path.join(target, name)
        os.makedirs(os.path.dirname(goal), exist_ok=True)
        try:
            if mode == "copy":
                raise OSError
            (os.link if mode == "hardlink" else os.symlink)(os.path.abspath(source), goal)
            used.add(mode)
        except OSError:
            shutil.copy2(source, goal)
            used.add("copy")
    return used.pop() if len(used) == 1 else "mixed" if used else mode


def prepare_scene(spark: SparkSession, model: submodel.Model, manifest: dict, images: dict[str, str], root: str, overwrite: bool = False, link_mode: str = "hardlink", dry_run: bool = False, min_track_length: int = 1) -> dict:
    """Training and test sub-models and images of one manifest under root; with dry_run only what the manifest says, and nothing is read.

    The manifest must keep its rules and every listed image must have a file. Each sub-model is computed once, for its files; their heads give the counts.
    """
    check_manifest(spark, manifest)
    sides = {"train_scene": manifest["training_images"], "test_scene": manifest["test_images"]}
    out = {"experiment": manifest["experiment_name"], "dry_run": dry_run, "link_mode": link_mode}
    if dry_run:
        return out | {side: {"images": len(names), "points": 0, "cameras": 0} for side, names in sides.items()}
    for names in sides.values():
        if lacking := [x for x in names if x not in images]:
            raise FileNotFoundError(f"images without a file: {lacking[:5]}")
    fresh_folder(root, overwrite)
    modes = set()
    for side, names in sides.items():
        part = submodel.filter_model(model, spark.createDataFrame([(x,) for x in names], "name string"), min_track_length)
        modes.add(link_images({x: images[x] for x in names}, os.path.join(root, side, "images"), link_mode))
        folder = os.path.join(root, side, "sparse", "0")
        write_model(part, folder)
        out[side] = {k: record_count(os.path.join(folder, f"{stem}.bin")) for k, stem in (("images", "images"), ("points", "points3D"), ("cameras", "cameras"))}
    out["link_mode"] = modes.pop() if len(modes) == 1 else "mixed"
    write_json(os.path.join(root, "scene_manifest.json"), {"prepared_scene": out, "experiment": manifest})
    return out


def reconstruction_summary(stages: DataFrame, model: submodel.Model, total_images: int | None = None) -> DataFrame:
    """One wide row: seconds of each stage and the model's summary. stages: stage, return_code, duration_seconds."""
    times = stages.agg(F.sum("duration_seconds").alias("total_seconds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "duration_seconds")))).alias("stage_seconds"), F.max(F.abs("return_code")).alias("worst_return_code"))
    first = model.cameras.agg(F.min_by("model", "camera_id").alias("first_camera_model"))
    return times.crossJoin(first).crossJoin(submodel.model_summary(model, total_images))
