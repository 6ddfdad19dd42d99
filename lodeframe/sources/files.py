"""Images, archives, manifests, results and logs as tables."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import enforce, manifest_violations, result_violations
from ..schema import IMAGE_EXTENSIONS, MANIFEST, RESULT
from . import paths

#: Archives that hold each scene.
SCENES = {**dict.fromkeys(("bicycle", "bonsai", "counter", "garden", "kitchen", "room", "stump"), "360_v2.zip"), **dict.fromkeys(("flowers", "treehill"), "360_extra_scenes.zip")}


def is_image(path: str) -> Column:
    """Whether a path ends like an image's, in either case."""
    return F.lower(path).rlike("(" + "|".join(x.replace(".", r"\.") for x in IMAGE_EXTENSIONS) + ")$")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the images under root at any depth; none if root is missing. Contents aren't read."""
    if not paths.is_folder(root):
        return spark.createDataFrame([], "path string, length bigint")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return found.filter(is_image("path"))


def in_path_order(files: DataFrame) -> DataFrame:
    """Sorted by path components, so a folder's files come before those of a longer name."""
    return files.orderBy(F.split("path", "/"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """origin, height, width, nChannels, mode, data (BGR) of the images under root. An undecodable file has height -1 and is no error."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*").filter(is_image("origin"))


def undecodable(df: DataFrame, shown: int = 10) -> DataFrame:
    """The first few images that don't decode or have no RGB, RGBA or gray pixels."""
    return df.filter((F.col("height") < 0) | ~F.col("nChannels").isin(1, 3, 4)).select("origin").orderBy("origin").limit(shown)


def check_images(df: DataFrame) -> None:
    """A dataset has at least one image, and all of its images decode."""
    if df.select("origin").isEmpty():
        raise ValueError("a dataset without images")
    if found := [r.origin for r in undecodable(df).collect()]:
        raise ValueError(f"images that don't decode: {found}")


def manifests(spark: SparkSession, path: str | list[str], checked: bool = True) -> DataFrame:
    """Manifests of JSON files. checked: one that breaks a rule is an error."""
    out = spark.read.schema(MANIFEST).json(path, multiLine=True)
    if checked:
        enforce(manifest_violations(out), "manifest")
    return out


def results(spark: SparkSession, path: str | list[str], checked: bool = True) -> DataFrame:
    """Results of JSON files. checked: one that breaks a rule is an error."""
    out = spark.read.schema(RESULT).json(path, multiLine=True)
    if checked:
        enforce(result_violations(out), "result")
    return out


def logs(spark: SparkSession, path: str) -> DataFrame:
    """path and text, a row for each file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def catalogue(spark: SparkSession) -> DataFrame:
    """(scene, archive) of all known scenes."""
    return spark.createDataFrame(sorted(SCENES.items()), "scene string, archive string")


def scene_archives(requests: DataFrame, scene: str = "scene") -> DataFrame:
    """requests with the archive of each scene, whose name is taken without outer blanks and in lower case; null where it is unknown."""
    known = catalogue(requests.sparkSession).select(F.col("scene").alias("__scene"), "archive")
    return requests.join(F.broadcast(known), F.lower(F.trim(F.col(scene))) == F.col("__scene"), "left").drop("__scene")


def scene_archive(scene: str) -> str:
    key = scene.strip().lower()
    if key not in SCENES:
        raise ValueError(f"unknown scene {scene!r}; known: {sorted(SCENES)}")
    return SCENES[key]


def safe_member(name: str, scene: str) -> str | None:
    """The member's path inside the scene, or null for other members and folders; an unsafe path is an error."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith("/") or ".." in parts or (parts and ":" in parts[0]):
        raise ValueError(f"unsafe archive member {name!r}")
    if parts[0] != scene or name.endswith("/"):
        return None
    inner = "/".join(x for x in parts[1:] if x)
    return inner or None


def archive_listing(spark: SparkSession, archives: list[str], scene: str) -> DataFrame:
    """archive, name, member (inside the scene) and size of the scene's members. Executors read the archives' directories, not their bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin in batch["archive"].to_pylist():
                with paths.opened(origin) as file, zipfile.ZipFile(file) as archive:
                    found = [(i.filename, m, i.file_size) for i in archive.infolist() if (m := safe_member(i.filename, scene))]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([origin] * len(found), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["archive", "name", "member", "size"])

    return spark.createDataFrame([(x,) for x in archives], "archive string").mapInArrow(run, "archive string, name string, member string, size bigint")


def archive_members(spark: SparkSession, archives: str | list[str], scene: str) -> DataFrame:
    """archive, member (inside the scene), size and content of zip files: members are listed first and then read by themselves, dealt over the cluster, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, name, member in zip(*(batch[c].to_pylist() for c in ("archive", "name", "member")), strict=True):
                with paths.opened(origin) as file, zipfile.ZipFile(file) as archive:
                    data = archive.read(name)
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([member]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "member", "size", "content"])

    listing = archive_listing(spark, [archives] if isinstance(archives, str) else archives, scene)
    return listing.select("archive", "name", "member").repartition("member").mapInArrow(run, "archive string, member string, size bigint, content binary")


def extract_scene(spark: SparkSession, archive: str, scene: str, target: str, overwrite: bool = False) -> int:
    """The scene's members as files under target; how many. They are written beside it first and moved there when all are there. A target with files is an error unless overwrite."""
    if paths.listed(target) and not overwrite:
        raise FileExistsError(target)
    staged = target.rstrip("/") + ".partial"
    paths.removed(staged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, member in zip(batch["name"].to_pylist(), batch["member"].to_pylist(), strict=True):
                with paths.opened(archive) as file, zipfile.ZipFile(file) as source, source.open(name) as data, paths.created(paths.joined(staged, member)) as out:
                    while part := data.read(1 << 20):
                        out.write(part)
                yield pa.RecordBatch.from_arrays([pa.array([member])], names=["member"])

    written = archive_listing(spark, [archive], scene).select("name", "member").repartition("member").mapInArrow(run, "member string").count()
    if not written:
        raise ValueError(f"{archive} has nothing of {scene}")
    paths.removed(target)
    paths.renamed(staged, target)
    return written
