"""Semantics that the standard tables don't show."""

import json
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodeframe import config, runtime
from lodeframe.functions import scalar as S
from lodeframe.operators import dedup, features, matching, metrics, pixels, quality, results, sampling, select, submodel, validation
from lodeframe.plans import experiments, scenes
from lodeframe.schema import CAMERA, IMAGE, MANIFEST, POINT3D
from lodeframe.sources import files, sfm, video


def clip(spark, total, fps=24.0):
    return spark.createDataFrame([("v", total, fps)], "video string, total_frames bigint, fps double")


def indices(df):
    return sorted(r.frame_index for r in df.collect())


def test_sampling_strategies(spark):
    assert indices(sampling.select_frames(clip(spark, 23), interval=5)) == [0, 5, 10, 15, 20]
    assert indices(sampling.select_frames(clip(spark, 100, 25.0), seconds=1.3)) == [0, 32, 64, 96]  # 32.5 goes to the even side
    assert indices(sampling.select_frames(clip(spark, 9, 2.0), seconds=0.01)) == list(range(9))
    assert indices(sampling.select_frames(clip(spark, 8), target=3)) == [0, 4, 7]  # 3.5 goes to the even side
    assert indices(sampling.select_frames(clip(spark, 4), target=50)) == [0, 1, 2, 3]
    assert indices(sampling.select_frames(clip(spark, 77), target=1)) == [0]
    for wrong in ({"interval": 2, "seconds": 0.5}, {}, {"target": 0}, {"seconds": -1.0}):
        with pytest.raises(ValueError):
            sampling.select_frames(clip(spark, 4), **wrong)


def names(spark, n, scene="s"):
    return spark.createDataFrame([(scene, f"view{k:04d}.png") for k in range(n)], "scene string, name string")


@pytest.mark.parametrize("large", [False, True])
def test_split_and_budget(spark, large):
    split = sampling.heldout_split(names(spark, 45).union(names(spark, 3, None)), "scene", "name", interval=6, offset=2, large=large).cache()
    held = {r.name for r in split.filter("is_test and scene = 's'").collect()}
    assert held == {f"view{k:04d}.png" for k in range(2, 45, 6)} and split.filter("is_test and scene is null").count() == 1
    chosen = sorted(r.name for r in sampling.fixed_budget(split.filter("scene = 's'"), "scene", 9, large=large).collect())
    assert len(chosen) == 9 and chosen[0] == "view0000.png" and chosen[-1] == "view0043.png" and not held & set(chosen)
    assert sampling.uniform_budget(names(spark, 12), "scene", "name", 1, large=large).first().name == "view0006.png"
    assert sampling.uniform_budget(names(spark, 5), "scene", "name", 5, large=large).count() == 5
    assert sampling.uniform_budget(names(spark, 5), "scene", "name", 6, strict=False, large=large).count() == 5
    with pytest.raises(PySparkException):
        sampling.uniform_budget(names(spark, 5), "scene", "name", 6, large=large).count()
    for wrong in ({"interval": 1}, {"offset": 8}, {"offset": -1}):
        with pytest.raises(ValueError):
            sampling.heldout_split(names(spark, 3), "scene", "name", **wrong)


def test_published_split(spark):
    """The published funnel: 292 images give 37 test and 255 training ones."""
    split = sampling.heldout_split(names(spark, 292), "scene", "name")
    assert split.filter("is_test").count() == 37 and split.filter("not is_test").count() == 255


@pytest.mark.parametrize("n,b", [(11, 4), (41, 13), (300, 90), (6, 6), (9, 2)])
def test_budget_formula(spark, n, b):
    got = sorted(r.position for r in sampling.uniform_budget(names(spark, n), "scene", "name", b).collect())
    assert got == [(i * (n - 1) + (b - 1) // 2) // (b - 1) for i in range(b)]


def candidates(spark):
    """A spiral of 31 views that look outwards; every ninth from the fifth on is unusable."""
    rows = []
    for i in range(31):
        turn = 0.4 * i
        out = [math.cos(turn), math.sin(turn), 0.0]
        rows.append(("s", f"v{i}", i, [2 * out[0], 2 * out[1], 0.1 * i], out, i % 9 != 5, 300.0 + 40 * i, 90.0 + 2 * i, 0.01 * i, 0.02, 200 + 35 * i))
    return spark.createDataFrame(rows, "scene string, name string, order_index bigint, camera_center array<double>, viewing_direction array<double>, valid boolean, blur_score double, mean_brightness double, dark_pixel_ratio double, bright_pixel_ratio double, feature_count bigint")


def test_greedy(spark):
    first = sorted(r.name for r in select.greedy_selection(candidates(spark), "scene", 7).collect())
    assert first == sorted(r.name for r in select.greedy_selection(candidates(spark).repartition(3), "scene", 7).collect())
    assert len(first) == 7 and {"v0", "v30"} <= set(first) and not {"v5", "v14", "v23"} & set(first)
    assert select.greedy_selection(candidates(spark), "scene", 28).count() == 28
    with pytest.raises(PySparkException):
        select.greedy_selection(candidates(spark), "scene", 29).count()
    with pytest.raises(ValueError):
        select.normalised_weights({"pose_diversity": -1})
    told = select.diagnostics(candidates(spark), "scene", 7).first()
    assert (told.candidate_count, told.usable_candidate_count, told.quality_filter_used, told.pose_signal_count) == (31, 28, True, 31) and sum(told.weights.values()) == pytest.approx(1)


def naive(c, d, order, q, f, budget, seq, w):
    scale = math.sqrt(((c.max(0) - c.min(0)) ** 2).sum()) or 1.0

    def dist(i, j):
        turn = math.acos(max(-1.0, min(1.0, float(d[i] @ d[j])))) / math.pi
        return 0.55 * min(1.0, math.sqrt(((c[i] - c[j]) ** 2).sum()) / scale) + 0.3 * turn + 0.15 * abs(order[i] - order[j]) / max(1, seq)

    chosen = [0, len(order) - 1]
    while len(chosen) < budget:
        rest = [k for k in range(len(order)) if k not in chosen]
        chosen.append(max(rest, key=lambda k: (w[0] * min(dist(k, j) for j in chosen) + w[1] * q[k] + w[2] * f[k], -k)))
    return sorted(chosen)


def test_running_minimum_is_naive_greedy():
    rng = np.random.default_rng(3)
    c, d = rng.normal(size=(50, 3)), rng.normal(size=(50, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    q, f, order = rng.random(50), rng.random(50), np.arange(50.0)
    w = (0.65, 0.25, 0.1)
    assert select.greedy(c, d, order, q, f, 14, 49.0, w) == naive(c, d, order, q, f, 14, 49.0, w)


def test_poses(spark):
    half = math.sqrt(0.5)
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [4.0, -5.0, 0.5]), ([half, 0.0, half, 0.0], [1.0, 0.0, 2.0])], "q array<double>, t array<double>")
    still, turned = df.select(S.camera_center(F.col("q"), F.col("t")).alias("c"), S.viewing_direction(F.col("q")).alias("d")).collect()
    assert still.c == [-4, 5, -0.5] and still.d == [0, 0, 1]
    # a quarter turn about y: R = [[0,0,1],[0,1,0],[-1,0,0]], so the centre is -R't and the view its last row
    assert turned.c == pytest.approx([2, 0, -1]) and turned.d == pytest.approx([-1, 0, 0])


#: Views 7, 8, 9, 12 and 20 of two cameras; point 5000 is seen by 7, 9, 12 (twice) and 20, point 5001 by 8 and 9, point 5002 by 20.
SEEN = {7: [5000, -1], 8: [5001], 9: [-1, 5001, 5000], 12: [5000, 5000], 20: [5002, 5000], 33: []}


def model(spark):
    cameras = spark.createDataFrame([(3, "SIMPLE_RADIAL", 1920, 1080, [900.0, 960.0, 540.0, 0.01]), (4, "OPENCV", 800, 600, [float(k) for k in range(8)])], CAMERA)
    images = spark.createDataFrame([(n, [0.5, 0.5, -0.5, 0.5], [0.25 * n, -1.0, 3.5], 3 if n < 20 else 4, f"room/view {n}.png", [(1.5 * k, 2.5 * n, p) for k, p in enumerate(seen)]) for n, seen in SEEN.items()], IMAGE)
    track = {p: [(n, k) for n, seen in SEEN.items() for k, q in enumerate(seen) if q == p] for p in (5000, 5001, 5002)}
    points = spark.createDataFrame([(p, [0.1 * p, -2.0, 7.25], [p % 200, 20, 30], 0.75, entries) for p, entries in track.items()], POINT3D)
    return submodel.Model(cameras, images, points)


def wanted(spark, *numbers):
    return spark.createDataFrame([(f"room/view {n}.png",) for n in numbers], "name string")


def test_sub_model(spark):
    out = submodel.filter_model(model(spark), wanted(spark, 9, 12))
    assert {r.point3d_id: [tuple(e) for e in r.track] for r in out.points.collect()} == {5000: [(9, 2), (12, 0), (12, 1)], 5001: [(9, 1)]}
    assert {r.image_id for r in out.images.collect()} == {9, 12} and [r.camera_id for r in out.cameras.collect()] == [3]
    cut = submodel.filter_model(model(spark), wanted(spark, 9, 12, 33), min_track_length=2)
    assert {r.image_id: [p.point3d_id for p in r.points2d] for r in cut.images.collect()} == {9: [-1, -1, 5000], 12: [5000, 5000], 33: []}
    assert {r.camera_id for r in cut.cameras.collect()} == {3, 4} and cut.points.count() == 1
    with pytest.raises(PySparkException):
        submodel.filter_model(model(spark), wanted(spark, 9, 10)).images.collect()
    assert submodel.filter_model(model(spark), spark.createDataFrame([], "name string")).images.count() == 0


def same(a, b):
    for x, y, key in ((a.cameras, b.cameras, "camera_id"), (a.images, b.images, "image_id"), (a.points, b.points, "point3d_id")):
        assert x.orderBy(key).collect() == y.select(*x.columns).orderBy(key).collect()


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_binary_round_trip(spark, tmp_path, split):
    sfm.write_model(model(spark), str(tmp_path / "deep" / "m"))
    spark.dataSource.register(sfm.SfmSource)
    read = [spark.read.format("sfm").option("table", x).option("splitBytes", split).load(str(tmp_path / "deep" / "m")) for x in sfm.TABLES]
    same(model(spark), submodel.Model(*read))
    assert (read[1].rdd.getNumPartitions() > 1) == (split == 64)
    same(model(spark), sfm.read_model(spark, f"file://{tmp_path}/deep/m", complete=True))
    assert sfm.find_model(str(tmp_path / "deep")) == str(tmp_path / "deep" / "m") and sorted(os.listdir(tmp_path / "deep" / "m")) == ["cameras.bin", "images.bin", "points3D.bin"]
    with pytest.raises(PySparkException):
        sfm.write_model(model(spark), str(tmp_path / "deep" / "m"))
    sfm.write_model(model(spark), str(tmp_path / "deep" / "m"), overwrite=True)
    row = submodel.model_summary(model(spark), 24).first()
    assert (row.number_of_cameras, row.camera_models, row.registered_images, row.registration_rate, row.number_of_observations) == (2, ["OPENCV", "SIMPLE_RADIAL"], 6, 0.25, 8)


def test_empty_model(spark, tmp_path):
    sfm.write_model(submodel.Model(*[x.filter("false") for x in (model(spark).cameras, model(spark).images, model(spark).points)]), str(tmp_path / "m"))
    assert (tmp_path / "m" / "images.bin").read_bytes() == bytes(8) and sfm.read_model(spark, str(tmp_path / "m")).images.count() == 0
    with pytest.raises(sfm.ModelError):
        sfm.read_model(spark, str(tmp_path / "m"), complete=True)


def test_text_model(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# id model size parameters\n\n9 FOV 320 200 1.5 2.5 3 4 5e-1\n")
    (tmp_path / "images.txt").write_text("41 0.6 0 0.8 0 -3 2.25 9 9 hall left.tif\n0.5 7 300 8 9.5 18446744073709551615 4 4 301 6 6 -1\n# between\n40 1 0 0 0 0 0 0 9 nothing seen.png\n\n")
    (tmp_path / "points3D.txt").write_text("300 -1 0 2.5 0 127 255 1.25 41 0\n301 4 5 6 1 2 3 0 41 2 40 0\n")
    out = sfm.read_model(spark, str(tmp_path))
    empty, seen = out.images.orderBy("image_id").collect()
    assert [p.point3d_id for p in seen.points2d] == [300, -1, 301, -1] and seen.name == "hall left.tif" and empty.points2d == []
    assert [len(r.track) for r in out.points.orderBy("point3d_id").collect()] == [1, 2] and out.cameras.first().params[-1] == 0.5
    for file, text in (("points3D.txt", "300 1.0\n"), ("points3D.txt", "300 -1 0 2.5 0 127 255 1.25 41\n"), ("cameras.txt", "9 FOV 320\n")):
        (tmp_path / file).write_text(text)
        with pytest.raises(PySparkException):
            (sfm.read_model(spark, str(tmp_path)).points if "points" in file else sfm.read_model(spark, str(tmp_path)).cameras).count()
    with pytest.raises(sfm.ModelError):
        sfm.read_model(spark, str(tmp_path / "none"))


def test_truncated_binary(spark, tmp_path):
    sfm.write_model(model(spark), str(tmp_path / "m"))
    for table, (stem, _) in sfm.TABLES.items():
        file = tmp_path / "m" / f"{stem}.bin"
        whole = file.read_bytes()
        for cut in (4, 11, len(whole) // 2, len(whole) - 1):
            file.write_bytes(whole[:cut])
            with pytest.raises(sfm.ModelError):
                sfm.ranges(str(file), table)
        file.write_bytes(whole)
    with pytest.raises(sfm.ModelError):
        sfm._binary_camera(sfm.Bytes((1).to_bytes(4, "little") + (99).to_bytes(4, "little") + bytes(16)))
    with pytest.raises(sfm.ModelError):
        sfm._pack("camera", {"camera_id": 1, "model": "PINHOLE", "width": 1, "height": 1, "params": [1.0]})


def picture(seed=0, h=120, w=160, shift=0):
    """Gray blocks of random brightness, moved to the right."""
    blocks = np.random.default_rng(seed).integers(0, 256, (h // 8, w // 8 + 8))
    whole = np.kron(blocks, np.ones((8, 8))).astype(np.uint8)
    return np.repeat(whole[:, 24 - shift : 24 - shift + w, None], 3, 2)


def test_images(spark, tmp_path):
    for name, value in (("night", 6), ("snow", 250), ("fog", 119)):
        (tmp_path / f"{name}.PNG").write_bytes(pixels.png(np.full((11, 17, 3), value, np.uint8)))
    (tmp_path / "torn.png").write_bytes(b"\x89PNG but no more")
    (tmp_path / "notes.txt").write_bytes(b"words")
    out = {os.path.basename(r.origin): r for r in experiments.analyse_frames(files.images(spark, str(tmp_path)), blur_threshold=0.0).collect()}
    assert {k: r.selection_reason for k, r in out.items()} == {"night.PNG": "underexposed", "snow.PNG": "overexposed", "fog.PNG": "selected", "torn.png": "invalid_image"}
    assert out["night.PNG"].dark_pixel_ratio == 1 and out["snow.PNG"].bright_pixel_ratio == 1 and out["fog.PNG"].mean_brightness == 119 and out["torn.png"].height is None
    found = [os.path.basename(r.path) for r in files.in_path_order(files.image_files(spark, str(tmp_path))).collect()]
    assert found == sorted(found) and len(found) == 4 and files.image_files(spark, str(tmp_path / "none")).count() == 0
    assert files.undecodable(files.images(spark, str(tmp_path))).count() == 1
    with pytest.raises(ValueError, match="torn"):
        files.check_images(files.images(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="without images"):
        files.check_images(files.images(spark, str(tmp_path)).filter("false"))


def test_features_and_selection(spark, tmp_path):
    points, bits = features.detect(picture()[..., 0])
    assert len(points) > 40 and bits.shape == (len(points), 4) and features.detect(picture()[..., 0], 10)[0].shape == (10, 2)
    assert len(features.detect(np.zeros((20, 500), np.uint8))[0]) == 0 and len(features.detect(np.full((90, 90), 7, np.uint8))[0]) == 0
    rules = features.Rules(minimum_matches=15)
    moved = features.compare((points, bits), features.detect(picture(shift=16)[..., 0]), (120, 160), rules)
    assert moved.median_motion_ratio == pytest.approx(16 / 200, abs=1e-6) and not moved.redundant
    again = features.compare((points, bits), (points, bits), (120, 160), rules)
    assert again.redundant and again.similarity_score == 1 and again.geometric_inlier_count == again.match_count
    poor = features.compare((points[:5], bits[:5]), (points, bits), (120, 160), rules)
    assert poor == features.Comparison(0, None, None, None, False)
    shots = {"a": picture(), "b": picture(), "c": picture(shift=16), "d": np.full((120, 160, 3), 4, np.uint8), "e": picture(shift=16)}
    for name, image in shots.items():
        (tmp_path / f"{name}.png").write_bytes(pixels.png(image))
    analysed = experiments.analyse_frames(files.images(spark, str(tmp_path)), maximum_features=500).withColumn("scene", F.lit("s"))
    out = {r.filename: r for r in experiments.select_distinct(analysed, "scene", "origin", rules=rules).collect()}
    assert {k[0]: r.selection_reason for k, r in out.items()} == {"a": "selected", "b": "redundant", "c": "selected", "d": "underexposed" if out["d.png"].blur_score >= 100 else "blur", "e": "redundant"}
    assert [out[f"{k}.png"].frame_id for k in "abcde"] == [1, 2, 3, 4, 5] and out["a.png"].match_count is None and out["b.png"].similarity_score == 1


def test_preprocess(spark, tmp_path):
    (tmp_path / "wide.png").write_bytes(pixels.png(np.full((30, 90, 3), (200, 100, 50), np.uint8)))
    row = pixels.preprocess(files.images(spark, str(tmp_path)), 45, 40).first()
    assert (row.original_width, row.original_height, row.output_width, row.output_height, row.resized) == (90, 30, 45, 15, True)
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "x.png").write_bytes(bytes(row.png))
    assert files.images(spark, str(tmp_path / "small")).select(pixels.rgb_column()("height", "width", "nChannels", "data").alias("p")).first().p[:3] == pytest.approx([200 / 255, 100 / 255, 50 / 255])
    smooth = np.add.outer(np.arange(40), np.arange(60)).astype(np.uint8)[..., None].repeat(3, 2)
    half = pixels.resized(smooth, 30, 20)
    assert half.shape == (20, 30, 3) and np.abs(half[2:-2, 2:-2, 0].astype(int) - smooth[4:-4:2, 4:-4:2, 0] - 1).max() <= 1
    tiff = b"MM\0*\0\0\0\x08\0\x01" + b"\x01\x12\0\x03\0\0\0\x01\0\x06\0\0"
    body = b"Exif\0\0" + tiff
    assert pixels.orientation(b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body) == 6 and pixels.orientation(b"\x89PNG") == 1
    corner = np.zeros((2, 3), np.uint8)
    corner[0, 0] = 1
    places = {1: (0, 0), 2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (2, 1), 8: (2, 0)}
    for how, place in places.items():
        turned = pixels.upright(corner[..., None], how)[..., 0]
        assert turned[place] == 1 and turned.shape == ((2, 3) if how < 5 else (3, 2)), how


def mp4(scale, table, width, height):
    def box(kind, *body):
        data = b"".join(body)
        return (len(data) + 8).to_bytes(4, "big") + kind + data

    number = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    stts = box(b"stts", number(0, len(table)), *[number(*x) for x in table])
    media = box(b"mdia", box(b"mdhd", number(0, 0, 0, scale, 0)), box(b"hdlr", number(0, 0), b"vide"), box(b"minf", box(b"stbl", stts)))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", number(0, 0), b"soun")))
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(50)) + box(b"moov", sound, box(b"trak", box(b"tkhd", bytes(76), number(width << 16, height << 16)), media))


def test_videos(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(mp4(600, [(10, 20), (5, 40)], 320, 180))
    (tmp_path / "b.mp4").write_bytes(mp4(600, [], 320, 180))
    (tmp_path / "c.mp4").write_bytes(b"\0\0\0\x08ftyp")
    found = {r.path.rsplit("/")[-1]: r for r in video.videos(spark, [str(tmp_path / x) for x in ("a.mp4", "b.mp4", "c.mp4", "gone.mp4")]).collect()}
    assert (found["a.mp4"].fps, found["a.mp4"].total_frames, found["a.mp4"].width, found["a.mp4"].height, found["a.mp4"].rule) == (22.5, 15, 320, 180, None)
    assert found["a.mp4"].duration_seconds == pytest.approx(15 / 22.5) and [found[x].rule for x in ("b.mp4", "c.mp4", "gone.mp4")] == ["fps", "container", "missing"]


def test_archive(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, data in (("attic/images/p1.jpg", b"abc"), ("attic/sparse/0/x.bin", b""), ("cellar/p2.jpg", b"z")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    assert scenes.zip_folder(str(tree), str(tmp_path / "a.zip")) == ["attic/images/p1.jpg", "attic/sparse/0/x.bin", "cellar/p2.jpg"]
    got = {r.member: (r.size, bytes(r.content)) for r in files.archive_members(spark, str(tmp_path / "a.zip"), "attic").collect()}
    assert got == {"images/p1.jpg": (3, b"abc"), "sparse/0/x.bin": (0, b"")}
    assert files.extract_scene(spark, str(tmp_path / "a.zip"), "attic", str(tmp_path / "out")) == 2 and (tmp_path / "out/images/p1.jpg").read_bytes() == b"abc" and not (tmp_path / "out.partial").exists()
    with pytest.raises(FileExistsError):
        files.extract_scene(spark, str(tmp_path / "a.zip"), "attic", str(tmp_path / "out"))
    with pytest.raises(ValueError):
        files.extract_scene(spark, str(tmp_path / "a.zip"), "roof", str(tmp_path / "none"))
    for unsafe in ("attic/../x", "/attic/x", "c:/attic/x"):
        with pytest.raises(ValueError):
            files.safe_member(unsafe, "attic")
    assert files.scene_archive(" Garden ") and pytest.raises(ValueError, files.scene_archive, "moon")


def test_scene_bundle(spark, tmp_path):
    for name, data in (("in/pictures/deep/k.JPG", b"1"), ("in/pictures/l.tiff", b"2"), ("in/pictures/readme.md", b"3"), *((f"in/model/{x}", bytes(8)) for x in scenes.MODEL_FILES)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    made = scenes.bundle_scene(str(tmp_path / "in/pictures"), str(tmp_path / "in/model"), str(tmp_path / "out"), archive=str(tmp_path / "out.zip"))
    assert made.image_count == 2 and made.extensions == [".jpg", ".tiff"] and made.model_files == list(scenes.MODEL_FILES) and zipfile.ZipFile(tmp_path / "out.zip").namelist()[0] == "images/deep/k.JPG"
    for change, error in (({}, FileExistsError), ({"overwrite": True, "shipped": str(tmp_path / "in")}, scenes.SceneError)):
        with pytest.raises(error):
            scenes.bundle_scene(str(tmp_path / "in/pictures"), str(tmp_path / "in/model"), str(tmp_path / "out"), **change)
    scenes.refuse_shipped_model(str(tmp_path / "in/model"), str(tmp_path / "in/mod"))
    with pytest.raises(scenes.SceneError):
        scenes.Training("s", "m", iterations=0)
    with pytest.raises(scenes.SceneError):
        scenes.Training("s", "m").render_command(-2)


def test_metrics(spark):
    rng = np.random.default_rng(0)
    x = rng.random((20, 13, 3))
    assert metrics.ssim(x, x) == 1.0 and metrics.ssim(x, 1 - x) < 0.2 and metrics.ssim(np.full_like(x, 0.3), np.full_like(x, 0.9)) == pytest.approx((2 * 0.27 + 1e-4) / (0.9 + 1e-4))
    with pytest.raises(ValueError):
        metrics.ssim(x[:6], x[:6])
    with pytest.raises(ValueError):
        metrics.ssim(x, x[:-1])
    df = spark.createDataFrame([([0.1] * 5, [0.6] * 5)], "a array<double>, b array<double>")
    assert df.select(S.psnr(F.col("a"), F.col("b"))).first()[0] == pytest.approx(-10 * math.log10(0.25)) and math.isinf(df.select(S.psnr(F.col("a"), F.col("a"))).first()[0])
    mixed = spark.createDataFrame([("all", math.inf), ("some", 7.0), ("some", math.inf), ("none", None), ("finite", 2.5), ("finite", 4.5)], "k string, x double").groupBy("k").agg(metrics.inf_aware_mean(F.col("x")).alias("m"))
    assert {r.k: r.m for r in mixed.collect()} == {"all": math.inf, "some": None, "none": None, "finite": 3.5}


def test_evaluation(spark):
    truth = spark.createDataFrame([("s", "k1.tif", 0, [0.25] * 99), ("s", "k2.tif", 1, [0.5] * 99)], "scene string, name string, position bigint, pixels array<double>")
    renders = spark.createDataFrame([("s", "k1.jpeg", [0.25] * 99), ("s", "00001.png", [0.75] * 99)], "scene string, name string, pixels array<double>")
    each, means = experiments.evaluate_views(truth, renders, "scene", 11, 9)
    first, second = each.orderBy("image_name").collect()
    assert first.render_name == "k1.jpeg" and math.isinf(first.psnr) and first.ssim == 1.0 and first.lpips is None and second.render_name == "00001.png" and second.psnr == pytest.approx(12.0412, abs=1e-4)
    assert means.first().psnr_mean is None and means.first().images == 2
    with pytest.raises(validation.Violation):
        experiments.evaluate_views(truth, renders.filter("name <> 'k1.jpeg'"), "scene", 11, 9)


def test_manifests(spark, tmp_path):
    looks = candidates(spark).withColumn("name", F.format_string("view%04d.png", "order_index"))
    out = experiments.build_manifests(names(spark, 31), experiments.experiment_specs(fixed=[4], automatic=6, full=True), candidates=looks).cache()
    rows = {r.experiment_name: r for r in out.collect()}
    assert rows["fixed_4"].train_image_count == 4 and rows["full"].train_image_count == rows["full"].training_budget == 27 and rows["automatic_6"].training_budget == 6
    assert rows["automatic_6"].quality_status == "computed" and rows["fixed_4"].quality_status is None and not set(rows["full"].training_images) & set(rows["full"].test_images)
    bad = spark.createDataFrame([("x", "fixed_uniform", 2, ["p.tif", "q.tif"], ["q.tif"], 2, 1, 9)], MANIFEST)
    assert [r.rule for r in validation.manifest_violations(bad).collect()] == ["training and test overlap"]
    done = results.placeholders(out)
    assert validation.result_violations(done).count() == 0 and done.first().status == "not_run" and done.first().psnr is None
    results.write_csv(results.csv_rows(done.withColumn("warnings", F.array(F.lit("late"), F.lit("short")))), str(tmp_path / "r"))
    assert "late; short" in next((tmp_path / "r").glob("*.csv")).read_text()
    assert json.loads(results.json_document(done).first().document)["phase"] == 5
    written = experiments.write_manifests(out, str(tmp_path / "m"))
    assert [x.rsplit("/", 2)[1:] for x in written] == [["s", "automatic_6.json"], ["s", "fixed_4.json"], ["s", "full.json"]]
    assert files.manifests(spark, written[2]).first().total_scene_images == 31
    data = json.loads((tmp_path / "m/s/fixed_4.json").read_text())
    experiments.write_json(str(tmp_path / "wrong.json"), data | {"train_image_count": 5})
    with pytest.raises(validation.Violation):
        files.manifests(spark, str(tmp_path / "wrong.json"))


def test_prepare_scene(spark, tmp_path):
    images = {f"room/view {n}.png": str(tmp_path / "src" / f"{n}.png") for n in SEEN}
    (tmp_path / "src").mkdir()
    for path in images.values():
        with open(path, "wb") as file:
            file.write(b"x")
    manifest = {"experiment_name": "fixed_3", "selection_method": "fixed_uniform", "training_budget": 3, "training_images": ["room/view 7.png", "room/view 9.png", "room/view 12.png"], "test_images": ["room/view 8.png"], "train_image_count": 3, "test_image_count": 1, "total_scene_images": 6}
    dry = experiments.prepare_scene(spark, model(spark), manifest, {}, str(tmp_path / "out"), dry_run=True)
    assert dry["train_scene"]["images"] == 3 and not (tmp_path / "out").exists()
    out = experiments.prepare_scene(spark, model(spark), manifest, images, str(tmp_path / "out"))
    assert out["link_mode"] == "hardlink" and out["train_scene"] == {"images": 3, "points": 2, "cameras": 1} and out["test_scene"] == {"images": 1, "points": 1, "cameras": 1}
    assert sfm.read_model(spark, str(tmp_path / "out/train_scene/sparse/0")).images.count() == 3 and (tmp_path / "out/test_scene/images/room/view 8.png").exists()
    assert json.loads((tmp_path / "out/scene_manifest.json").read_text())["experiment"] == manifest
    with pytest.raises(FileExistsError):
        experiments.prepare_scene(spark, model(spark), manifest, images, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        experiments.prepare_scene(spark, model(spark), manifest, {k: v for k, v in images.items() if "9" not in k}, str(tmp_path / "other"))
    with pytest.raises(validation.Violation):
        experiments.prepare_scene(spark, model(spark), manifest | {"test_image_count": 2}, images, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_comparison_rules(spark):
    df = spark.createDataFrame([(10, 100, 50, 0.0, None), (100, 100, 0, None, None), (100, 100, 95, 0.001, 95), (100, 100, 95, 0.02, 95)], "na int, nb int, matches int, motion double, inliers int")
    rows = experiments.compare_frames(df).collect()
    assert [(r.matches, r.similarity, r.redundant) for r in rows[:2]] == [(0, None, False), (0, 0.0, False)]
    assert rows[2].redundant and not rows[3].redundant


def test_inliers(spark):
    rng = np.random.default_rng(1)
    p = rng.random((40, 2)) * 500
    assert matching.inlier_count(p[:7], p[:7]) is None
    wrong = p + [20.0, 0.0]
    wrong[30:] = rng.random((10, 2)) * 500
    assert 30 <= matching.inlier_count(p, wrong) <= 36 and matching.inlier_count(p, wrong) == matching.inlier_count(p, wrong)
    # eight points of which no epipolar geometry holds eight, but a plane holds seven
    few, moved = p[:9], p[:9] * 1.5 + [3.0, 9.0]
    moved[7:] = [[900.0, 3.0], [2.0, 700.0]]
    assert matching._planar(few, moved, 3.0, 200, np.random.default_rng(0)) == 7
    df = spark.createDataFrame([(g, *a, *b) for g, n in ((1, 40), (2, 7)) for a, b in zip(p[:n].tolist(), wrong[:n].tolist(), strict=True)], "pair int, xa double, ya double, xb double, yb double")
    assert {r.pair: (r.matches, r.inliers) for r in matching.geometric_inliers(df, "pair").collect()} == {1: (40, matching.inlier_count(*(x[np.lexsort(np.hstack([p, wrong])[:, ::-1].T)] for x in (p, wrong)))), 2: (7, None)}


def test_nearest_in_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, (150, 4)).astype(float), rng.integers(0, 9, (60, 4)).astype(float)
    left, right = (spark.createDataFrame([(1, k, v) for k, v in enumerate(x.tolist())], "block int, id bigint, v array<double>") for x in (a, b))
    monkeypatch.setattr(matching, "LEFT_ROWS", 40)
    monkeypatch.setattr(matching, "TILE", 16)
    d = ((a[:, None] - b) ** 2).sum(2)
    want = {(i, int(j), r + 1) for i in range(150) for r, j in enumerate(np.lexsort((np.arange(60), d[i]))[:3])}
    assert {(r.a, r.b, r["rank"]) for r in matching.nearest(left, right, "block", k=3).collect()} == want
    assert matching.nearest(left, right.filter("false"), "block").count() == 0


def test_long_groups_fold_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 50, 230).tolist()
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(values)] + [("h", 0, None), ("h", 1, 2.0)], "g string, k bigint, v double")
    kept, last = [], None
    for k, v in enumerate(values):
        if last is None or abs(v - last) >= 9:
            kept.append(k)
            last = v
    for size in (1, 7, 512):
        monkeypatch.setattr(dedup, "BLOCK", size)
        got = dedup.carried_dedup(df, "g", ["k"], "v", lambda a, b: F.abs(a - b) >= 9, "k")
        assert sorted(r.k for r in got.filter("g = 'g'").collect()) == kept and [r.k for r in got.filter("g = 'h'").collect()] == [0]


def test_order_is_checked_within_and_between_partitions(spark):
    """No keys are gathered: a row a partition is, and none for an empty one."""
    from lodeframe.queries_files import _in_order

    def told(keys):
        return tuple(_in_order(spark.createDataFrame(spark.sparkContext.parallelize([(x,) for x in keys], 3), "key long")).first())

    assert told([1, 2, 2, 5, 6, 7]) == (6, True)
    assert told([1, 2, 2, 1, 6, 7]) == (6, False)
    assert told([2, 1, 3, 4, 6, 7]) == (6, False)
    assert told([5]) == (1, True)
    assert told([]) == (0, True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the standard tables")
def test_large_files_are_read_in_larger_parts(spark, monkeypatch):
    from lodeframe import queries_files

    monkeypatch.setattr(queries_files, "PARTS", 3)
    seen, kept = [], queries_files._in_order
    monkeypatch.setattr(queries_files, "_in_order", lambda keys: (seen.append(keys.rdd.getNumPartitions()), kept(keys))[1])
    rows = {r.part: (r.rows, r.sorted) for r in queries_files.sorted_write(spark, "/root/testdata/sf0.001").collect()}
    assert rows["image"] == (1500, True) and max(seen) <= 4


def test_bytes_are_rounded_as_doubles_stand(spark):
    def said(n, largest):
        size, units = float(n), ("B", "KB", "MB", "GB", "TB")
        for unit in units[: units.index(largest) + 1]:
            if size < 1024 or unit == largest:
                return f"{size:.1f} {unit}"
            size /= 1024

    # ties, doubles next to one (2^60 and more), negative ones, ends of units
    numbers = [0, 256, 768, 1023, 1024, 1280, 1792, -5, -1536, 1048524, 1048525, 1048575, (1 << 40) - 1, 1 << 40, (1 << 50) + 1, (1 << 63) - 1, 1152921559582428416, 1152922439191730688]
    rows = spark.createDataFrame([(x,) for x in numbers], "n long").select("n", S.human_bytes(F.col("n")).alias("tb"), S.human_bytes(F.col("n"), largest="GB").alias("gb")).collect()
    assert [(r.n, r.tb, r.gb) for r in rows] == [(n, said(n, "TB"), said(n, "GB")) for n in numbers]
    assert spark.range(1).select(S.human_bytes(F.lit(None).cast("long")).alias("s")).first().s is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the standard tables")
def test_bytes_beyond_a_terabyte_match_their_sql(spark, tmp_path):
    """The query's SQL has no unit above GB; keys as those of six times sf0.1 reach it."""
    import duckdb

    from lodeframe.queries import QUERIES, SQL

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + 898500).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = sorted(duck.sql(SQL["human_bytes"]).fetchall())
    assert any(float(x[2].split()[0]) >= 1024 for x in wanted)
    assert sorted(tuple(r) for r in QUERIES["human_bytes"](spark, str(tmp_path)).collect()) == wanted


def test_runtime(spark, tmp_path):
    runtime.seed_everything(11)
    first = np.random.random()
    runtime.seed_everything(11)
    assert np.random.random() == first and runtime.runtime_info(spark)["spark"] == spark.version
    log = runtime.logger("lodeframe-test", str(tmp_path))
    log.info("kept")
    assert "kept" in next(tmp_path.glob("run_*.log")).read_text() and len(runtime.logger("lodeframe-test").handlers) == 1


def test_flat_image_has_no_edges():
    blur, mean, dark, bright = quality.image_statistics(np.full((5, 5, 3), 128, np.uint8))
    assert (blur, mean, dark, bright) == (0, 128, 0, 0)


def test_config():
    text = "room:\n  size: [4, 2.5, yes, null, 'x y']  # metres\n  door:\n    open: False\n  note: \"# kept\"\nlast: -7\nodd: [nan, inf, none, 1_000, 1e5, .5e-1]\nnothing:\n"
    assert config.parse_yaml(text) == {"room": {"size": [4, 2.5, "yes", None, "x y"], "door": {"open": False}, "note": "# kept"}, "last": -7, "odd": ["nan", "inf", "none", "1_000", "1e5", 0.05], "nothing": {}}
    for wrong in ("a:\n\tb: 1\n", "a\n", ": 1\n", "a: 1\n  b: 2\n", "a:\n    b: 1\n  c: 2\n"):
        with pytest.raises(config.ConfigError):
            config.parse_yaml(wrong)
    assert config.validate(config.defaults()) == config.defaults()
    for path, value in (("quality.max_bright_pixel_ratio", 1.5), ("video.frame_interval", -3), ("frame_selection.lowe_ratio", 0), ("colmap.backend", "odd"), ("phase5.split.holdout_offset", 9), ("video.time_interval", 2.5), ("quality.blur_threshold", float("nan")), ("preprocessing.jpeg_quality", float("inf")), ("quality.minimum_feature_count", "nan")):
        with pytest.raises(config.ConfigError, match=path.split(".")[-1] if "time" not in path else "one"):
            config.validate(config.with_value(config.defaults(), path, value))
    assert config.merge({"p": {"q": 1, "r": [2]}}, {"p": {"q": {"s": 3}}}) == {"p": {"q": {"s": 3}, "r": [2]}}
    assert config.backend(config.defaults(), importable=False) == "cli" and config.matcher(config.defaults(), "video") == "sequential"
    with pytest.raises(config.ConfigError):
        config.matcher(config.defaults(), "audio")
