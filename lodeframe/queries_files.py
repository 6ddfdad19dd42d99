"""Queries of readers, writers, plans and rules: files are made from whole tables in the shared folder, read by the operators, and held against SQL over the tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config
from .functions import scalar as S
from .operators import matching, metrics, pixels, results, sampling, select, submodel, validation
from .plans import experiments, scenes
from .queries import CANDIDATES, FRAMES, PAIRED, SCORE, _candidates, _frames, _model, _paired, query, r4, s4, t
from .schema import FRAME_QUALITY, names
from .schema import struct as fields
from .scratch import fresh_path
from .sources import files, paths, sfm, video


def _folder(spark, name: str) -> str:
    return fresh_path(spark, name)


def _local(spark, name: str) -> str:
    """The same as a plain path, for links and folders of this machine."""
    return paths.located(_folder(spark, name))[1]


def _nations(spark, sf) -> list:
    return t(spark, sf, "nation").orderBy("n_nationkey").collect()


def _name(path: str, depth: int = 1) -> F.Column:
    return F.element_at(F.split(path, "/"), -depth)


# pictures: nation k is a file of one colour; every fifth is broken and every seventh is no image

RED, GREEN, BLUE = "n_nationkey * 10", "n_nationkey * 5", "255 - n_nationkey * 10"
PICTURES = f"""SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder, 'n' || n_nationkey || CASE WHEN n_nationkey % 7 = 6 THEN '.txt' WHEN n_nationkey % 3 = 0 THEN '.PNG' ELSE '.png' END AS name,
 n_nationkey % 7 <> 6 AS image, n_nationkey % 5 <> 4 AS sound, {RED} AS r, {GREEN} AS g, {BLUE} AS b, 30 + n_nationkey AS h, 40 + n_nationkey AS w FROM nation"""


def _picture_folder(spark, sf) -> str:
    import numpy as np

    root = _folder(spark, "pictures")
    for row in _nations(spark, sf):
        k = row.n_nationkey
        name = f"n{k}" + (".txt" if k % 7 == 6 else ".PNG" if k % 3 == 0 else ".png")
        image = np.empty((30 + k, 40 + k, 3), np.uint8)
        image[:] = (10 * k, 5 * k, 255 - 10 * k)
        paths.write_bytes(paths.joined(root, "ab"[k % 2], name), b"not an image" if k % 5 == 4 else pixels.png(image))
    return root


def _pictures(spark, sf) -> DataFrame:
    return files.images(spark, _picture_folder(spark, sf)).withColumn("name", _name("origin"))


@query(f"SELECT folder, name, row_number() OVER (ORDER BY folder, name) - 1 AS position FROM ({PICTURES}) WHERE image")
def image_discovery(spark, sf):
    found = files.image_files(spark, _picture_folder(spark, sf)).select(_name("path", 2).alias("folder"), _name("path").alias("name"), F.lit(0).alias("root"))
    return sampling.positions(found, "root", ["folder", "name"]).drop("root")


@query(f"SELECT name, CASE WHEN sound THEN h ELSE -1 END AS height, CASE WHEN sound THEN w ELSE -1 END AS width, CASE WHEN sound THEN printf('%02X%02X%02X', b::INT, g::INT, r::INT) ELSE '' END AS first_pixel, CASE WHEN sound THEN 3 * h * w ELSE 0 END AS bytes FROM ({PICTURES}) WHERE image")
def image_decode(spark, sf):
    return _pictures(spark, sf).select("name", "height", "width", F.hex(F.substring("data", 1, 3)).alias("first_pixel"), F.octet_length("data").alias("bytes"))


@query(f"SELECT name, 3 * h * w AS numbers, {s4('r / 255')} AS r, {s4('g / 255')} AS g, {s4('b / 255')} AS b FROM ({PICTURES}) WHERE image AND sound")
def image_rgb(spark, sf):
    p = _pictures(spark, sf).filter("height > 0").select("name", pixels.rgb_column()("height", "width", "nChannels", "data").alias("p"))
    return p.select("name", F.size("p").alias("numbers"), *[r4(F.get("p", k).cast("double")).alias(c) for k, c in enumerate("rgb")])


@query(f"SELECT name FROM ({PICTURES}) WHERE image AND NOT sound ORDER BY folder, name LIMIT 10")
def dataset_check(spark, sf):
    return files.undecodable(_pictures(spark, sf)).select(_name("origin").alias("name"))


@query(f"""SELECT name, CASE WHEN sound THEN y END AS mean_brightness, CASE WHEN sound THEN (y <= 30)::INT END AS dark, CASE WHEN sound THEN (y >= 150)::INT END AS bright,
CASE WHEN NOT sound THEN 'invalid_image' WHEN y < 40 OR y <= 30 THEN 'underexposed' WHEN y > 140 THEN 'overexposed' ELSE 'selected' END AS selection_reason FROM (SELECT *, round_even(0.114 * b + 0.587 * g + 0.299 * r, 0) AS y FROM ({PICTURES}) WHERE image)""")
def frame_analysis(spark, sf):
    out = experiments.analyse_frames(_pictures(spark, sf), bright_cutoff=150, blur_threshold=0.0, min_brightness=40.0, max_brightness=140.0)
    return out.select("name", "mean_brightness", F.col("dark_pixel_ratio").cast("int").alias("dark"), F.col("bright_pixel_ratio").cast("int").alias("bright"), "selection_reason")


@query(f"""SELECT name, greatest(1, round_even(w * s, 0))::INT AS width, greatest(1, round_even(h * s, 0))::INT AS height, s < 1 AS resized, printf('%02X%02X%02X', b::INT, g::INT, r::INT) AS first_pixel
FROM (SELECT *, least(50 / w, 45 / h, 1.0) AS s FROM ({PICTURES}) WHERE image AND sound)""")
def image_preprocess(spark, sf):
    out = pixels.preprocess(_pictures(spark, sf).filter("height > 0"), 50, 45)
    root = _folder(spark, "fitted")
    for row in out.toLocalIterator():
        paths.write_bytes(paths.joined(root, row.origin.rsplit("/", 1)[1]), bytes(row.png))
    back = files.images(spark, root).select(_name("origin").alias("name"), "width", "height", F.hex(F.substring("data", 1, 3)).alias("first_pixel"))
    return back.join(out.select(_name("origin").alias("name"), "resized"), "name")


VIEWS = "SELECT n_regionkey, 'v' || n_nationkey || '.png' AS image_name, n_nationkey / 50 AS x, CASE WHEN n_regionkey = 1 OR n_regionkey = 2 AND n_nationkey > 9 THEN n_nationkey / 50 ELSE (n_nationkey + 1) / 50 END AS y FROM nation"
VIEW_METRICS = f"SELECT *, CASE WHEN x = y THEN 'inf'::DOUBLE ELSE -10 * log10(pow(x - y, 2)) END AS psnr, (2 * x * y + 0.0001) / (x * x + y * y + 0.0001) AS ssim FROM ({VIEWS})"


def _views(spark, sf):
    n = t(spark, sf, "nation").withColumn("image_name", F.format_string("v%d.png", "n_nationkey"))
    same = (F.col("n_regionkey") == 1) | ((F.col("n_regionkey") == 2) & (F.col("n_nationkey") > 9))
    x, y = F.col("n_nationkey") / 50, F.when(same, F.col("n_nationkey") / 50).otherwise((F.col("n_nationkey") + 1) / 50)
    truth = n.select("n_regionkey", F.col("image_name").alias("name"), F.col("n_nationkey").cast("long").alias("position"), F.array_repeat(x, 64).alias("pixels"))
    return experiments.evaluate_views(truth, n.select("n_regionkey", F.col("image_name").alias("name"), F.array_repeat(y, 64).alias("pixels")), "n_regionkey", 8, 8)


def _shown(x):
    return F.when(x == float("inf"), "inf").otherwise(r4(x).cast("string"))


@query(f"SELECT image_name, image_name AS render_name, CASE WHEN isinf(psnr) THEN 'inf' ELSE ({s4('psnr')})::VARCHAR END AS psnr, {s4('ssim')} AS ssim FROM ({VIEW_METRICS})")
def view_metrics(spark, sf):
    return _views(spark, sf)[0].select("image_name", "render_name", _shown(F.col("psnr")).alias("psnr"), r4(F.col("ssim")).alias("ssim"))


@query(f"""SELECT n_regionkey, count(*) AS images, CASE WHEN bool_and(isinf(psnr)) THEN 'inf' WHEN bool_or(isinf(psnr)) THEN NULL ELSE ({s4('avg(psnr)')})::VARCHAR END AS psnr_mean, {s4('avg(ssim)')} AS ssim_mean FROM ({VIEW_METRICS}) GROUP BY 1""")
def view_means(spark, sf):
    return _views(spark, sf)[1].select("n_regionkey", "images", _shown(F.col("psnr_mean")).alias("psnr_mean"), r4(F.col("ssim_mean")).alias("ssim_mean"))


@query("""SELECT 'image_name,render_name,psnr,ssim,lpips' AS line UNION ALL SELECT 'v' || n_nationkey || '.png,' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'r' || n_nationkey END || ',' || CASE WHEN n_nationkey % 3 = 0 THEN 'inf' ELSE n_nationkey || '.5' END || ',0.25,' FROM nation""")
def view_metrics_csv(spark, sf):
    k = F.col("n_nationkey")
    rows = t(spark, sf, "nation").select(F.format_string("v%d.png", k).alias("image_name"), F.when(k % 4 != 0, F.format_string("r%d", k)).alias("render_name"), F.when(k % 3 == 0, float("inf")).otherwise(k + 0.5).alias("psnr"), F.lit(0.25).alias("ssim"), F.lit(None).cast("double").alias("lpips"))
    path = _folder(spark, "views")
    experiments.write_view_metrics(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


HEADER = ",".join(names(FRAME_QUALITY))


@query(f"""SELECT '{HEADER}' AS line UNION ALL SELECT doc_id || ',' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE (2 * doc_id)::VARCHAR END || ',f' || doc_id || '.jpg,' || doc_id || '.5,0.25,' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE doc_id || '.0' END || ',0.0,1.0,7,,,' ||
CASE WHEN doc_id % 2 = 0 THEN 'True,selected' ELSE 'False,blur' END FROM documents""")
def frame_quality_csv(spark, sf):
    k = F.col("doc_id")
    given = {
        "frame_id": k, "source_frame_index": F.when(k % 3 != 0, 2 * k), "filename": F.format_string("f%d.jpg", k), "timestamp_seconds": k + 0.5, "blur_score": F.lit(0.25), "mean_brightness": F.when(k % 5 != 0, k.cast("double")), "dark_pixel_ratio": F.lit(0.0),
        "bright_pixel_ratio": F.lit(1.0), "feature_count": F.lit(7), "selected": k % 2 == 0, "selection_reason": F.when(k % 2 == 0, "selected").otherwise("blur"),
    }
    rows = t(spark, sf, "documents").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(FRAME_QUALITY).fields])
    path = _folder(spark, "frames")
    experiments.write_frame_quality(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


S7 = [f"{r * 8 + c + 1}" for r in range(7) for c in range(7)]
WINDOWS = f"SELECT vec_id, o, unnest([{', '.join(f'ea[o + {i}]::DOUBLE' for i in S7)}]) AS x, unnest([{', '.join(f'eb[o + {i}]::DOUBLE' for i in S7)}]) AS y FROM ({PAIRED}), (SELECT unnest([0, 1, 8, 9]) AS o)"


@query(f"""SELECT vec_id, {s4('avg(s)')} AS ssim FROM (SELECT vec_id, o, (2 * avg(x) * avg(y) + 0.0001) * (2 * covar_samp(x, y) + 0.0009) / ((pow(avg(x), 2) + pow(avg(y), 2) + 0.0001) * (var_samp(x) + var_samp(y) + 0.0009)) AS s FROM ({WINDOWS}) GROUP BY 1, 2) GROUP BY 1""")
def ssim(spark, sf):
    return _paired(spark, sf).select("vec_id", r4(metrics.ssim_column(8, 8)("ea", "eb")).alias("ssim"))


# a model as text: nations are cameras and points, suppliers are images, whose k-th 2D point (of s_suppkey % 4) belongs to the nation but for the second

LINKS = "SELECT s_suppkey, s_nationkey, k, CASE WHEN k = 1 THEN -1 ELSE s_nationkey END AS point FROM (SELECT *, unnest(range(0, s_suppkey % 4)) AS k FROM supplier)"


def _text_model(spark, sf) -> str:
    root = _folder(spark, "text-model")
    nations, suppliers = _nations(spark, sf), t(spark, sf, "supplier").orderBy("s_suppkey").collect()
    track = {n.n_nationkey: [(s.s_suppkey, k) for s in suppliers if s.s_nationkey == n.n_nationkey for k in range(s.s_suppkey % 4) if k != 1] for n in nations}
    lines = {
        "cameras": ["# cameras", *[f"{n.n_nationkey} PINHOLE 640 480 500 500 320 {n.n_regionkey}" for n in nations]],
        "images": ["# images"],
        "points3D": [f"{n.n_nationkey} {n.n_regionkey} 0.5 1 9 8 7 0.25 " + " ".join(f"{a} {b}" for a, b in track[n.n_nationkey]) for n in nations],
    }
    for s in suppliers:
        points = " ".join(f"{k}.5 1.0 {[s.s_nationkey, -1, s.s_nationkey][k] if s.s_suppkey % 2 else [s.s_nationkey, 2**64 - 1, s.s_nationkey][k]}" for k in range(s.s_suppkey % 4))
        lines["images"] += [f"{s.s_suppkey} 1 0 0 0 {s.s_acctbal!r} 0 0 {s.s_nationkey} {s.s_name} view.jpg", points]
    for stem, content in lines.items():
        paths.write_bytes(paths.joined(root, "child", stem + ".txt"), "\n".join(content).encode() + b"\n")
    return root


def _read_text_model(spark, sf) -> submodel.Model:
    return sfm.read_model(spark, sfm.find_model(_text_model(spark, sf)), complete=True)


@query("SELECT n_nationkey AS camera_id, 'PINHOLE' AS model, 640::BIGINT AS width, n_regionkey::DOUBLE AS last_parameter FROM nation")
def text_model_cameras(spark, sf):
    return _read_text_model(spark, sf).cameras.select("camera_id", "model", "width", F.element_at("params", -1).alias("last_parameter"))


@query(f"""SELECT s_suppkey::INT AS image_id, s_nationkey AS camera_id, s_name || ' view.jpg' AS name, {s4('-s_acctbal')} AS x, (s_suppkey % 4)::BIGINT AS num_points2d, (SELECT count(*) FROM ({LINKS}) l WHERE l.s_suppkey = s.s_suppkey AND point <> -1) AS num_observed_points FROM supplier s""")
def text_model_images(spark, sf):
    from .operators.geometry import image_poses

    return image_poses(_read_text_model(spark, sf).images).select("image_id", "camera_id", "name", r4(F.col("camera_center")[0]).alias("x"), "num_points2d", "num_observed_points")


@query(f"SELECT n_nationkey::BIGINT AS point3d_id, n_regionkey::DOUBLE AS x, (SELECT count(*) FROM ({LINKS}) WHERE point = n_nationkey) AS track_length FROM nation")
def text_model_points(spark, sf):
    return _read_text_model(spark, sf).points.select("point3d_id", F.col("xyz")[0].alias("x"), F.size("track").cast("long").alias("track_length"))


#: Parts that sorted_write reads a file in, about: beyond it they are larger, not more.
PARTS = 256


def _binary_model(spark, sf, split: int = sfm.SPLIT, parts: int | None = None) -> submodel.Model:
    """_model() written and read again in parts of about `split` bytes, or larger ones where a file would have more than so many parts."""
    m = _model(spark, sf)
    path = _folder(spark, "sfm")
    sfm.write_model(submodel.Model(m.cameras.withColumns({"model": F.lit("PINHOLE"), "params": F.array(*[F.lit(1.0)] * 4)}), m.images, m.points), path)
    spark.dataSource.register(sfm.SfmSource)
    sizes = {x: max(split, -(-paths.size_of(paths.joined(path, f"{stem}.bin")) // parts) if parts else 0) for x, (stem, _) in sfm.TABLES.items()}
    return submodel.Model(*[spark.read.format("sfm").option("table", x).option("splitBytes", size).load(path) for x, size in sizes.items()])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, first, last, rows, sorted) of a partition's keys; none for an empty one."""
    first = last = None
    rows, ordered = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["key"].to_numpy()
        ordered = ordered and bool((key[1:] >= key[:-1]).all()) and (last is None or int(key[0]) >= last)
        first, last, rows = int(key[0]) if first is None else first, int(key[-1]), rows + len(key)
    if rows:
        yield pa.RecordBatch.from_pydict({"place": [TaskContext.get().partitionId()], "first": [first], "last": [last], "rows": [rows], "sorted": [ordered]})


def _in_order(keys: DataFrame) -> DataFrame:
    """(rows, sorted) of a table of keys: whether they never fall, within partitions and from each to the next. A row a partition is gathered, no keys."""
    found = keys.mapInArrow(_runs, "place long, first long, last long, rows long, sorted boolean")
    ends = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "first", "last"))), lambda x: F.array(x["first"], x["last"])))
    return found.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), (F.coalesce(F.bool_and("sorted"), F.lit(True)) & (ends == F.array_sort(ends))).alias("sorted"))


@query("SELECT o_orderkey::INT AS image_id, 'image_' || o_orderkey || '.jpg' AS name, o_custkey::INT AS camera_id, o_totalprice AS z, count(l_orderkey) AS num_points2d, count(*) FILTER (l_partkey % 10 <> 0) AS linked FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def sfm_binary_roundtrip(spark, sf):
    linked = F.size(F.filter("points2d", lambda p: p["point3d_id"] != -1)).cast("long")
    return _binary_model(spark, sf).images.select("image_id", "name", "camera_id", F.col("tvec")[2].alias("z"), F.size("points2d").cast("long").alias("num_points2d"), linked.alias("linked"))


@query("SELECT c_custkey::INT AS camera_id, 'PINHOLE' AS model, 4 AS n_params FROM customer")
def sfm_binary_cameras(spark, sf):
    return _binary_model(spark, sf).cameras.select("camera_id", "model", F.size("params").alias("n_params"))


@query("SELECT p_partkey AS point3d_id, p_retailprice AS x, count(*) AS track_length, sum(l_orderkey)::BIGINT AS images FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey % 10 <> 0 GROUP BY ALL")
def sfm_binary_points(spark, sf):
    images = F.aggregate("track", F.lit(0).cast("long"), lambda s, e: s + e["image_id"])
    return _binary_model(spark, sf).points.select("point3d_id", F.col("xyz")[0].alias("x"), F.size("track").cast("long").alias("track_length"), images.alias("images"))


@query("""SELECT 'camera' AS part, count(*) AS rows, true AS sorted FROM customer UNION ALL SELECT 'image', count(*), true FROM orders UNION ALL SELECT 'point3d', count(DISTINCT l_partkey), true FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 10 <> 0""")
def sorted_write(spark, sf):
    """Rows in the order of the files, which small splits read as many parts, have growing ids."""
    m, out = _binary_model(spark, sf, split=1 << 14, parts=PARTS), None
    for part, df, key in (("camera", m.cameras, "camera_id"), ("image", m.images, "image_id"), ("point3d", m.points, "point3d_id")):
        one = _in_order(df.select(F.col(key).cast("long").alias("key"))).select(F.lit(part).alias("part"), "rows", "sorted")
        out = one if out is None else out.union(one)
    return out


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'text' WHEN 2 THEN 'binary' ELSE 'none' END AS format FROM nation")
def model_formats(spark, sf):
    root, out = _folder(spark, "formats"), []
    for row in _nations(spark, sf):
        k, found = row.n_nationkey, "none"
        wanted = [x for x, there in ((".bin", k % 4 != 1), (".txt", k % 4 in (1, 2))) if there]
        for suffix in wanted:
            for stem in ("cameras", "images", "points3D")[: 2 if k % 4 == 3 else 3]:
                paths.write_bytes(paths.joined(root, str(k), "0", stem + suffix), bytes(8) if suffix == ".bin" else b"")
        try:
            found = sfm.model_format(sfm.find_model(paths.joined(root, str(k))))
        except sfm.ModelError:
            pass
        out.append((k, found))
    return spark.createDataFrame(out, "n_nationkey int, format string")


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 2 WHEN 4 THEN 0 END::BIGINT AS track_length FROM nation""")
def parser_guards(spark, sf):
    """Text lines and binary records: sound ones are read, cut or malformed ones are errors."""
    out = []
    for row in _nations(spark, sf):
        k = row.n_nationkey
        whole = sfm._pack("point3d", {"point3d_id": k, "xyz": [1, 2, 3], "rgb": [1, 2, 3], "error": 0.5, "track": []})
        binary = {3: whole[:-1], 4: whole, 5: whole[:43] + struct.pack("<Q", 9)}
        try:
            if k % 6 < 3:
                (found,) = sfm._text_points((f"{k} 1 2 3 9 8 7 0.5 1 0 2 1", f"{k} 1 2 3 9 8 7 0.5 1 0 2", f"{k} 1 2")[k % 6])
            else:
                found = sfm._binary_point(sfm.Bytes(binary[k % 6]))
            size = len(found[4])
        except sfm.ModelError:
            size = None
        out.append((k, size))
    return spark.createDataFrame(out, "n_nationkey int, track_length bigint")


SPLIT = "SELECT lang, printf('%010d', doc_id) AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents"


def _manifests(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents").select(F.col("lang").alias("scene"), F.format_string("%010d", "doc_id").alias("name"))
    return experiments.build_manifests(d, experiments.experiment_specs(fixed=[2, 5], automatic=None, full=True))


@query(f"""WITH p AS ({SPLIT}), c AS (SELECT lang, count(*) FILTER (k % 8 <> 0) AS train, count(*) FILTER (k % 8 = 0) AS test, count(*) AS total, min(name) FILTER (k % 8 <> 0) AS first, max(name) FILTER (k % 8 <> 0) AS last FROM p GROUP BY 1)
SELECT lang AS scene, 'fixed_' || b AS experiment_name, b AS training_budget, b AS train_image_count, test AS test_image_count, total AS total_scene_images, first, last FROM c, (SELECT unnest([2, 5])::BIGINT AS b)
UNION ALL SELECT lang, 'full', train, train, test, total, first, last FROM c""")
def manifests_json(spark, sf):
    written = experiments.write_manifests(_manifests(spark, sf), _folder(spark, "manifests"))
    back = files.manifests(spark, written).withColumn("scene", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return back.select("scene", "experiment_name", "training_budget", "train_image_count", "test_image_count", "total_scene_images", F.get("training_images", F.lit(0)).alias("first"), F.element_at("training_images", -1).alias("last"))


@query(f"""WITH p AS ({SPLIT}), s AS (SELECT lang, name, k % 8 = 0 AS test FROM p), c AS (SELECT lang, count(*) FILTER (NOT test) AS n FROM s GROUP BY 1)
SELECT s.lang AS scene, 'not a candidate' AS rule FROM s WHERE test GROUP BY 1 UNION ALL SELECT lang, 'budget' FROM (SELECT lang, count(*) AS n FROM s GROUP BY 1) WHERE n <> 25""")
def selection_rules(spark, sf):
    """All images taken as a selection of 25: test images are no candidates, and there are too many."""
    split = sampling.heldout_split(t(spark, sf, "documents").select(F.col("lang").alias("scene"), "doc_id"), "scene", "doc_id", large=True)
    return validation.selection_violations(split, sampling.training_candidates(split), ["scene", "doc_id"], "scene", 25)


@query("SELECT l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS experiment, count(*) AS train_image_count, count(*) FILTER (l_quantity > 40) + 1 AS test_image_count, 'not_run' AS status, 2 AS n_warnings FROM lineitem GROUP BY 1")
def results_files(spark, sf):
    g = t(spark, sf, "lineitem").groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("experiment_name")).agg(F.count("*").alias("train_image_count"), (F.count_if(F.col("l_quantity") > 40) + 1).alias("test_image_count"))
    rows = results.placeholders(g.withColumns({"selection_method": F.lit("fixed_uniform"), "training_budget": F.lit(30)})).withColumn("warnings", F.array(F.lit("a"), F.lit("b")))
    root = _folder(spark, "results")
    for row in rows.toLocalIterator():
        experiments.write_json(paths.joined(root, f"{row.experiment}.json"), row.asDict())
    return files.results(spark, root).select("experiment", "train_image_count", "test_image_count", "status", F.size("warnings").alias("n_warnings"))


@query("""SELECT n_nationkey, n_name AS name, n_regionkey * 0.25::DOUBLE AS ratio, [n_nationkey, n_nationkey + 1]::BIGINT[] AS listed, n_nationkey % 2 = 0 AS flag, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '1_000' END AS odd FROM nation""")
def yaml_values(spark, sf):
    out = []
    for n in _nations(spark, sf):
        k = n.n_nationkey
        text = f"top:  # the whole row\n  name: '{n.n_name}'\n  deep:\n    ratio: {n.n_regionkey * 0.25}\n    listed: [{k}, {k + 1}]\n  flag: {str(k % 2 == 0).lower()}\nodd: {'~' if k % 3 == 0 else '1_000'}\n"
        read = config.parse_yaml(text)
        out.append((k, read["top"]["name"], read["top"]["deep"]["ratio"], read["top"]["deep"]["listed"], read["top"]["flag"], read["odd"]))
    return spark.createDataFrame(out, "n_nationkey int, name string, ratio double, listed array<bigint>, flag boolean, odd string")


def _broken(change: dict) -> bool:
    try:
        config.validate(config.merge(config.defaults(), change))
    except config.ConfigError:
        return True
    return False


@query("""SELECT n_nationkey, n_nationkey > 10 AS ratio, n_regionkey = 0 AS interval, n_nationkey % 3 <> 0 AS matcher, n_regionkey * 2 >= 5 AS "offset", n_nationkey % 4 = 0 AS quality FROM nation""")
def config_rules(spark, sf):
    out = []
    for n in _nations(spark, sf):
        k, r = n.n_nationkey, n.n_regionkey
        changes = [
            {"quality": {"max_dark_pixel_ratio": k / 10}}, {"video": {"frame_interval": r}}, {"colmap": {"matcher": "exhaustive" if k % 3 == 0 else "odd"}}, {"phase5": {"split": {"holdout_interval": 5, "holdout_offset": 2 * r}}},
            {"quality": {"blur_threshold": float("nan") if k % 4 == 0 else 1.0}},
        ]
        out.append((k, *map(_broken, changes)))
    return spark.createDataFrame(out, "n_nationkey int, ratio boolean, interval boolean, matcher boolean, offset boolean, quality boolean")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'base' END AS a, 'kept' AS b, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_regionkey END::BIGINT AS c FROM nation")
def config_merge(spark, sf):
    out = []
    for n in _nations(spark, sf):
        over = {"x": {"y": {"a": n.n_name}, "c": None}} if n.n_nationkey % 2 == 0 else {}
        both = config.merge({"x": {"y": {"a": "base", "b": "kept"}, "c": n.n_regionkey}}, over)["x"]
        out.append((n.n_nationkey, both["y"]["a"], both["y"]["b"], both["c"]))
    return spark.createDataFrame(out, "n_nationkey int, a string, b string, c bigint")


@query("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'exhaustive' WHEN 1 THEN 'sequential' ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'exhaustive' ELSE 'sequential' END END AS matcher,
CASE n_nationkey % 3 WHEN 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'pycolmap' ELSE 'cli' END WHEN 1 THEN 'cli' ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'pycolmap' ELSE 'error' END END AS backend FROM nation""")
def tool_choice(spark, sf):
    out = []
    for n in _nations(spark, sf):
        k = n.n_nationkey
        chosen = config.merge(config.defaults(), {"colmap": {"matcher": ["exhaustive", "sequential", "auto", "auto", "auto"][n.n_regionkey], "backend": ("auto", "cli", "pycolmap")[k % 3]}})
        try:
            backend = config.backend(chosen, importable=k % 2 == 0)
        except config.ConfigError:
            backend = "error"
        out.append((k, config.matcher(chosen, "video" if k % 2 else "dataset"), backend))
    return spark.createDataFrame(out, "n_nationkey int, matcher string, backend string")


@query("""SELECT n_nationkey, 'tool feature_extractor --database_path db --image_path ' || n_name || ' --ImageReader.camera_model PINHOLE --ImageReader.single_camera ' || CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '0' END AS extract,
CASE WHEN n_regionkey = 0 THEN 'tool sequential_matcher --database_path db --SequentialMatching.overlap ' || (n_nationkey + 1) ELSE 'tool exhaustive_matcher --database_path db' END AS match, 'tool mapper --database_path db --image_path ' || n_name || ' --output_path out' AS map FROM nation""")
def reconstruction_commands(spark, sf):
    out = []
    for n in _nations(spark, sf):
        c = config.merge(config.defaults(), {"paths": {"colmap_executable": "tool"}, "colmap": {"matcher": "exhaustive" if n.n_regionkey else "sequential", "single_camera": n.n_nationkey % 2 == 0, "sequential_overlap": n.n_nationkey + 1}})
        out.append((n.n_nationkey, *(" ".join(x) for x in config.reconstruction_commands(c, n.n_name, "db", "out"))))
    return spark.createDataFrame(out, "n_nationkey int, extract string, match string, map string")


@query("""SELECT n_nationkey, 'python train.py -s ' || n_name || ' -m out -i images --iterations ' || i || ' --test_iterations -1 --save_iterations ' || CASE WHEN n_regionkey = 0 THEN '7 9' ELSE i::VARCHAR END || ' --checkpoint_iterations ' || i || ' --disable_viewer' || CASE WHEN n_nationkey % 2 = 0 THEN ' --quiet' ELSE '' END AS train,
'python render.py -s ' || n_name || ' -m out -i images --iteration ' || CASE WHEN n_regionkey = 1 THEN 5 ELSE i END || ' --skip_test' || CASE WHEN n_nationkey % 2 = 0 THEN ' --quiet' ELSE '' END AS render,
'out/chkpnt' || i || '.pth out/point_cloud/iteration_' || i || '/point_cloud.ply out/train/ours_' || CASE WHEN n_regionkey = 1 THEN 5 ELSE i END || '/renders' AS outputs FROM (SELECT *, n_nationkey * 100 + 300 AS i FROM nation)""")
def trainer_commands(spark, sf):
    out = []
    for n in _nations(spark, sf):
        k = n.n_nationkey
        run = scenes.Training(n.n_name, "out", 300 + 100 * k, quiet=k % 2 == 0, save_at=(7, 9) if n.n_regionkey == 0 else None)
        at = 5 if n.n_regionkey == 1 else None
        out.append((k, " ".join(run.train_command()), " ".join(run.render_command(at)), " ".join(run.outputs(at).values())))
    return spark.createDataFrame(out, "n_nationkey int, train string, render string, outputs string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'in/' || n_name ELSE '/elsewhere/' || n_name END AS shown FROM nation")
def shown_paths(spark, sf):
    out = [(n.n_nationkey, config.shown_path(f"/base/in/{n.n_name}" if n.n_nationkey % 2 == 0 else f"/elsewhere/{n.n_name}", "/base")) for n in _nations(spark, sf)]
    return spark.createDataFrame(out, "n_nationkey int, shown string")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def utc_text(spark, sf):
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")
    return t(spark, sf, "events").select("event_id", S.utc_text(at).alias("at"))


@query("SELECT n_nationkey, (n_nationkey % 2) + (n_nationkey // 2 % 2) + (n_nationkey // 4 % 2) = 1 AND n_regionkey <> 4 AS accepted FROM nation")
def strategy_rule(spark, sf):
    out = []
    for n in _nations(spark, sf):
        k, value = n.n_nationkey, 0 if n.n_regionkey == 4 else 3
        try:
            sampling.check_strategy(value if k % 2 else None, value if k // 2 % 2 else None, value if k // 4 % 2 else None)
            accepted = True
        except ValueError:
            accepted = False
        out.append((k, accepted))
    return spark.createDataFrame(out, "n_nationkey int, accepted boolean")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN 'refused' ELSE 'empty' END AS result FROM nation")
def overwrite_guard(spark, sf):
    root, out = _local(spark, "guard"), []
    for n in _nations(spark, sf):
        k, folder = n.n_nationkey, f"{root}/{n.n_nationkey}"
        if k % 2:
            paths.write_bytes(f"{folder}/old", b"x")
        try:
            experiments.fresh_folder(folder, overwrite=k % 4 == 3)
            result = "empty" if not paths.listed(folder) else "left"
        except FileExistsError:
            result = "refused"
        out.append((k, result))
    return spark.createDataFrame(out, "n_nationkey int, result string")


@query("SELECT n_nationkey, ['copy', 'symlink', 'hardlink'][n_nationkey % 3 + 1] AS mode, n_name AS content FROM nation")
def linked_images(spark, sf):
    root, out = _local(spark, "links"), []
    for n in _nations(spark, sf):
        paths.write_bytes(f"{root}/from/{n.n_nationkey}.jpg", n.n_name.encode())
        mode = experiments.link_images({"x.jpg": f"{root}/from/{n.n_nationkey}.jpg"}, f"{root}/to/{n.n_nationkey}", ("copy", "symlink", "hardlink")[n.n_nationkey % 3])
        out.append((n.n_nationkey, mode, paths.text_of(f"{root}/to/{n.n_nationkey}/x.jpg")))
    return spark.createDataFrame(out, "n_nationkey int, mode string, content string")


SCENE_NAMES = ["bonsai", " Garden ", "flowers", "moon"]


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 2 THEN '360_extra_scenes.zip' WHEN 3 THEN NULL ELSE '360_v2.zip' END AS archive FROM nation")
def scene_sources(spark, sf):
    scene = F.get(F.array(*map(F.lit, SCENE_NAMES)), (F.col("n_nationkey") % 4).cast("int"))
    return files.scene_archives(t(spark, sf, "nation").select("n_nationkey", scene.alias("scene"))).select("n_nationkey", "archive")


def _archive(spark, sf) -> str:
    """A zip of one folder a region, with a file for each nation."""
    root = _folder(spark, "archive")
    for n in _nations(spark, sf):
        paths.write_bytes(paths.joined(root, "tree", f"r{n.n_regionkey}", "images", f"{n.n_nationkey}.jpg"), n.n_name.encode() * (n.n_nationkey + 1))
    scenes.zip_folder(paths.joined(root, "tree"), paths.joined(root, "all.zip"))
    return paths.joined(root, "all.zip")


@query("SELECT 'images/' || n_nationkey || '.jpg' AS member, (length(n_name) * (n_nationkey + 1))::BIGINT AS size, left(repeat(n_name, n_nationkey + 1), 12) AS head FROM nation WHERE n_regionkey = 1")
def archive_members(spark, sf):
    return files.archive_members(spark, _archive(spark, sf), "r1").select("member", "size", F.left(F.col("content").cast("string"), F.lit(12)).alias("head"))


@query("SELECT n_nationkey || '.jpg' AS name, (length(n_name) * (n_nationkey + 1))::BIGINT AS length FROM nation WHERE n_regionkey = 2")
def extracted_scene(spark, sf):
    target = _folder(spark, "extracted")
    files.extract_scene(spark, _archive(spark, sf), "r2", target)
    return files.image_files(spark, target).select(_name("path").alias("name"), "length")


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'no image' WHEN 1 THEN 'lacks' WHEN 2 THEN 'not 3' WHEN 3 THEN 'no folder' WHEN 4 THEN 'came with' ELSE '2 .jpg,.png 3' END AS result FROM nation""")
def scene_layout(spark, sf):
    root, out = _folder(spark, "layout"), []
    for n in _nations(spark, sf):
        k, folder = n.n_nationkey, paths.joined(root, str(n.n_nationkey))
        for name in ("a.jpg", "b.PNG")[: 0 if k % 6 == 0 else 2]:
            paths.write_bytes(paths.joined(folder, "images", name), b"x")
        for name in scenes.MODEL_FILES[: {1: 2, 3: 0}.get(k % 6, 3)]:
            paths.write_bytes(paths.joined(folder, "sparse", "0", name), bytes(8))
        try:
            if k % 6 == 4:
                scenes.refuse_shipped_model(paths.joined(folder, "sparse", "0"), paths.joined(folder, "sparse"))
            found = scenes.check_scene(folder, expected=3 if k % 6 == 2 else None)
            result = f"{found.image_count} {','.join(found.extensions)} {len(found.model_files)}"
        except scenes.SceneError as error:
            result = next(x for x in ("no image", "lacks", "not 3", "no folder", "came with") if x in str(error))
        out.append((k, result))
    return spark.createDataFrame(out, "n_nationkey int, result string")


def _avi(micros: int, frames: int, width: int, height: int) -> bytes:
    head = b"avih" + struct.pack("<I", 56) + struct.pack("<10I", micros, 0, 0, 0, frames, 0, 1, 0, width, height) + bytes(16)
    body = b"AVI " + b"LIST" + struct.pack("<I", 4 + len(head)) + b"hdrl" + head
    return b"RIFF" + struct.pack("<I", len(body)) + body


@query(f"""SELECT n_nationkey, {s4('fps')} AS fps, frames AS total_frames, CASE WHEN rule IS NULL THEN {s4('frames / fps')} END AS duration_seconds, rule FROM (SELECT *, CASE WHEN n_nationkey % 5 = 3 THEN 'container' WHEN n_nationkey = 0 THEN 'fps' WHEN n_regionkey = 2 THEN 'frame count' WHEN n_nationkey % 8 = 6 THEN 'dimensions' END AS rule,
CASE WHEN n_nationkey % 5 = 3 THEN NULL WHEN n_nationkey = 0 THEN 0 ELSE 1000000 / (n_nationkey * 10000) END AS fps, CASE WHEN n_nationkey % 5 = 3 THEN NULL WHEN n_regionkey = 2 THEN 0 ELSE n_nationkey * 7 + 1 END::BIGINT AS frames FROM nation)""")
def video_metadata(spark, sf):
    root, made = _folder(spark, "videos"), []
    for n in _nations(spark, sf):
        k, path = n.n_nationkey, paths.joined(root, f"{n.n_nationkey}.avi")
        data = _avi(10_000 * k, 0 if n.n_regionkey == 2 else 7 * k + 1, 0 if k % 8 == 6 else 64, 48)
        paths.write_bytes(path, b"junk" if k % 5 == 3 else data)
        made.append((k, path))
    out = video.videos(spark, [p for _, p in made])
    return out.join(spark.createDataFrame(made, "n_nationkey int, path string"), "path").select("n_nationkey", r4(F.col("fps")).alias("fps"), "total_frames", r4(F.col("duration_seconds")).alias("duration_seconds"), "rule")


@query(f"WITH f AS ({FRAMES}), m AS (SELECT user_id, count(*) AS matches FROM f GROUP BY 1) SELECT user_id, matches, CASE WHEN matches >= 8 THEN matches END AS inliers FROM m")
def geometric_inliers(spark, sf):
    """A user's events are points that all move alike, so every match agrees with one geometry."""
    f = _frames(spark, sf).select("user_id", F.pmod(F.col("event_id") * 7919, F.lit(640)).cast("double").alias("xa"), F.pmod(F.col("event_id") * 104729, F.lit(480)).cast("double").alias("ya"))
    return matching.geometric_inliers(f.withColumns({"xb": F.col("xa") + 20, "yb": F.col("ya") - 4}), "user_id", rounds=20)


BITS = "SELECT label, vec_id AS id, [" + ", ".join(f"CAST(floor(abs(embedding[{k}]::DOUBLE) * 1000) AS BIGINT)" for k in range(1, 9)) + "] AS v FROM embeddings"
HAMMING = "(SELECT a.label, a.id AS a, b.id AS b, " + " + ".join(f"bit_count(xor(a.v[{k}], b.v[{k}]))" for k in range(1, 9)) + f" AS d FROM ({BITS}) a JOIN ({BITS}) b ON a.label = b.label AND a.id % 2 = {{side}} AND b.id % 2 <> {{side}})"


def _bit_sides(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(F.abs(x.cast("double")) * 1000)).alias("v"))
    return e.filter("id % 2 = 0"), e.filter("id % 2 = 1")


def _bit_matches(spark, sf) -> DataFrame:
    a, b = _bit_sides(spark, sf)
    ratio = matching.ratio_matches(matching.nearest(a, b, "label", "hamming"), "label", 0.85)
    mutual = matching.mutual_matches(matching.nearest(a, b, "label", "hamming", 1), matching.nearest(b, a, "label", "hamming", 1), "label", 20)
    return matching.orb_matches(ratio, mutual, "label", 4)


ORB = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS rank FROM {HAMMING.format(side=0)}), g AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS rank FROM {HAMMING.format(side=1)}),
r AS (SELECT x.label, x.a, x.b, x.d FROM f x JOIN f y ON x.label = y.label AND x.a = y.a AND x.rank = 1 AND y.rank = 2 WHERE x.d < 0.85 * y.d), m AS (SELECT f.label, f.a, f.b, f.d FROM f JOIN g ON f.label = g.label AND f.a = g.b AND f.b = g.a AND f.rank = 1 AND g.rank = 1 WHERE f.d <= 20),
c AS (SELECT label, (SELECT count(*) FROM r WHERE r.label = l.label) AS nr, (SELECT count(*) FROM m WHERE m.label = l.label) AS nm FROM (SELECT DISTINCT label FROM embeddings) l),
o AS (SELECT r.* FROM r JOIN c ON c.label = r.label WHERE NOT (nr < 4 AND nm > nr) UNION ALL SELECT m.* FROM m JOIN c ON c.label = m.label WHERE nr < 4 AND nm > nr)"""


@query(f"{ORB} SELECT label, a, b, d::BIGINT AS distance FROM o")
def orb_matches(spark, sf):
    return _bit_matches(spark, sf).select("label", "a", "b", F.col("d").cast("long").alias("distance"))


@query(f"{ORB} SELECT label, a, b, row_number() OVER (PARTITION BY label ORDER BY d, a, b) - 1 AS position FROM o")
def matches_by_distance(spark, sf):
    return matching.in_distance_order(_bit_matches(spark, sf), "label").select("label", "a", "b", "position")


@query(f"""SELECT user_id, idx, m AS matches, CASE WHEN na < 40 OR nb < 40 THEN NULL WHEN m = 0 THEN 0 ELSE {s4('least(1, coalesce(i, m) / greatest(1, least(na, nb))) * greatest(0, 1 - least(1, motion / 0.05))')} END AS similarity,
na >= 40 AND nb >= 40 AND m >= 20 AND m > 0 AND least(1, coalesce(i, m) / greatest(1, least(na, nb))) * greatest(0, 1 - least(1, motion / 0.05)) >= 0.3 AND motion <= 0.05 AS redundant
FROM (SELECT user_id, idx, na, nb, CASE WHEN na < 40 OR nb < 40 THEN 0 ELSE event_id % 100 END AS m, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 // 2 END AS i, value / 5000 AS motion FROM (SELECT *, event_id % 90 + 20 AS na, event_id % 70 + 35 AS nb FROM ({FRAMES})))""")
def frame_comparison(spark, sf):
    e = F.col("event_id")
    pairs = _frames(spark, sf).select("user_id", "idx", (e % 90 + 20).alias("na"), (e % 70 + 35).alias("nb"), (e % 100).alias("matches"), (F.col("value") / 5000).alias("motion"), F.when(e % 3 != 0, F.floor(e % 100 / 2)).alias("inliers"))
    return experiments.compare_frames(pairs, min_matches=20, threshold=0.3, max_motion=0.05).select("user_id", "idx", "matches", r4(F.col("similarity")).alias("similarity"), "redundant")


@query("SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def exhaustive_pairs(spark, sf):
    return matching.all_pairs(t(spark, sf, "nation"), "n_regionkey", "n_nationkey")


@query(f"""WITH u AS (SELECT label, {SCORE} AS s, valid, blur, c0 FROM ({CANDIDATES})) SELECT label, count(*) AS candidate_count, CASE WHEN count(*) FILTER (valid AND s >= 0.6) >= 12 THEN count(*) FILTER (valid AND s >= 0.6) ELSE count(*) FILTER (valid) END AS usable_candidate_count,
count(*) FILTER (valid AND s >= 0.6) >= 12 AS quality_filter_used, count(blur) AS quality_signal_count, count(c0) AS pose_signal_count, 12::BIGINT AS budget, 'quality_filtered_greedy_pose_coverage' AS algorithm FROM u GROUP BY 1""")
def greedy_diagnostics(spark, sf):
    out = select.diagnostics(_candidates(spark, sf), "label", 12, minimum=0.6)
    return out.select("label", "candidate_count", "usable_candidate_count", "quality_filter_used", "quality_signal_count", "pose_signal_count", "budget", "algorithm")


SIDES = """SELECT 'train_scene' AS side, s_suppkey, s_nationkey, k FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier) WHERE k % 8 <> 0 UNION ALL SELECT 'test_scene', s_suppkey, s_nationkey, k FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier) WHERE k % 8 = 0"""


@query(f"SELECT side, count(*) AS images, count(DISTINCT CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END) AS points, count(DISTINCT s_nationkey) AS cameras, 'hardlink' AS mode FROM ({SIDES}) GROUP BY 1")
def prepared_scene(spark, sf):
    """Every eighth supplier is a test view of the text model, the others are training views."""
    root = _local(spark, "prepared")
    views = [f"{r.s_name} view.jpg" for r in t(spark, sf, "supplier").orderBy("s_suppkey").collect()]
    for name in views:
        paths.write_bytes(f"{root}/from/{name}", b"x")
    train, test = [x for k, x in enumerate(views) if k % 8], views[::8]
    manifest = {"experiment_name": "full", "selection_method": "all_training_candidates", "training_budget": None, "training_images": train, "test_images": test, "train_image_count": len(train), "test_image_count": len(test), "total_scene_images": len(views)}
    out = experiments.prepare_scene(spark, _read_text_model(spark, sf), manifest, {x: f"{root}/from/{x}" for x in views}, f"{root}/to")
    return spark.createDataFrame([(side, *(out[side][k] for k in ("images", "points", "cameras")), out["link_mode"]) for side in ("train_scene", "test_scene")], "side string, images bigint, points bigint, cameras bigint, mode string")


@query(f"""SELECT (SELECT sum(r_regionkey * 1.5::DOUBLE) FROM region) AS total_seconds, (SELECT count(*) FROM region) AS stages, 3 AS worst_return_code, 'PINHOLE' AS first_camera_model, (SELECT count(*) FROM nation) AS number_of_cameras, (SELECT count(*) FROM supplier) AS registered_images, 2000::BIGINT AS total_images,
{s4('(SELECT count(*) FROM supplier) / 2000')} AS registration_rate, (SELECT count(*) FROM nation) AS number_of_sparse_points, (SELECT count(*) FROM ({LINKS}) WHERE point <> -1) AS number_of_observations""")
def reconstruction_summary(spark, sf):
    stages = t(spark, sf, "region").select(F.col("r_name").alias("stage"), F.when(F.col("r_regionkey") == 2, -3).otherwise(0).alias("return_code"), (F.col("r_regionkey") * 1.5).alias("duration_seconds"))
    out = experiments.reconstruction_summary(stages, _read_text_model(spark, sf), 2000)
    return out.select("total_seconds", F.size("stage_seconds").cast("long").alias("stages"), "worst_return_code", "first_camera_model", "number_of_cameras", "registered_images", "total_images", r4(F.col("registration_rate")).alias("registration_rate"), "number_of_sparse_points", "number_of_observations")
