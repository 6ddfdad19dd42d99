"""A data source for sparse reconstruction models, binary and text: spark.read.format("sfm").option("table", ...)."""

from __future__ import annotations

import struct as packing
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.submodel import Model
from ..schema import CAMERA, CAMERA_MODELS, IMAGE, POINT3D, struct
from . import paths

TABLES = {"camera": ("cameras", CAMERA), "image": ("images", IMAGE), "point3d": ("points3D", POINT3D)}
NUMBERS = {name: (k, n) for k, (name, n) in enumerate(CAMERA_MODELS)}
#: Bytes of a binary file that one task reads, and the buffer with which record heads are scanned.
SPLIT, WINDOW = 32 << 20, 1 << 20
COUNT = packing.Struct("<Q")


class ModelError(ValueError):
    """A model that can't be read or written."""


def model_format(path: str) -> str:
    """binary where all three .bin files are, else text where all three .txt files are."""
    for kind, suffix in (("binary", ".bin"), ("text", ".txt")):
        if all(paths.is_file(paths.joined(path, stem + suffix)) for stem, _ in TABLES.values()):
            return kind
    raise ModelError(f"no complete model in {path}")


def find_model(root: str) -> str:
    """The folder of a model: root itself, or its first child with one."""
    for path in [root, *(paths.joined(root, x) for x in paths.listed(root))]:
        try:
            model_format(path)
            return path
        except ModelError:
            continue
    raise ModelError(f"no model under {root}")


class Bytes:
    """Little-endian reading with a check of the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        size = packing.calcsize("<" + layout)
        if self.at + size > len(self.data):
            raise ModelError("unexpected end of file")
        self.at += size
        return packing.unpack_from("<" + layout, self.data, self.at - size)

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ModelError("unterminated name")
        out, self.at = self.data[self.at : end].decode(), end + 1
        return out

    def count(self) -> int:
        (n,) = self.take("Q")
        if n >= 1 << 63:
            raise ModelError("a count that no signed number holds")
        return n


def _binary_camera(b: Bytes) -> tuple:
    ident, model, width, height = b.take("iiQQ")
    if not 0 <= model < len(CAMERA_MODELS):
        raise ModelError(f"camera model {model}")
    name, n = CAMERA_MODELS[model]
    return ident, name, width, height, list(b.take(f"{n}d"))


def _binary_image(b: Bytes) -> tuple:
    ident, *pose, camera = b.take("i7di")
    name, n = b.text(), b.count()
    flat = b.take("ddq" * n)
    return ident, pose[:4], pose[4:], camera, name, [(flat[k], flat[k + 1], flat[k + 2]) for k in range(0, 3 * n, 3)]


def _binary_point(b: Bytes) -> tuple:
    ident, x, y, z, red, green, blue, error = b.take("Q3d3Bd")
    if ident >= 1 << 63:
        raise ModelError("a point id that no signed number holds")
    n = b.count()
    flat = b.take("ii" * n)
    return ident, [x, y, z], [red, green, blue], error, list(zip(flat[::2], flat[1::2], strict=True))


RECORD = {"camera": _binary_camera, "image": _binary_image, "point3d": _binary_point}


class Heads:
    """Steps over the records of a binary file without reading their bodies: a window moves along the file."""

    def __init__(self, file, size: int):
        self.file, self.size, self.begin, self.held = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place + n > self.size:
            raise ModelError("unexpected end of file")
        if not self.begin <= place or place + n > self.begin + len(self.held):
            self.file.seek(place)
            self.begin, self.held = place, self.file.read(max(n, WINDOW))
        return self.held[place - self.begin : place - self.begin + n]

    def number(self, place: int, layout: str) -> int:
        return packing.unpack("<" + layout, self.at(place, packing.calcsize("<" + layout)))[0]

    def end_of_text(self, place: int) -> int:
        while place < self.size:
            part = self.at(place, min(256, self.size - place))
            if (found := part.find(b"\0")) >= 0:
                return place + found + 1
            place += len(part)
        raise ModelError("unterminated name")

    def after(self, table: str, place: int) -> int:
        """The end of the record that begins at place."""
        at = place - self.begin
        if at >= 0 and table == "image":  # most heads lie in the window
            end = self.held.find(b"\0", at + 64, at + 320)
            if 0 <= end <= len(self.held) - 9:
                return self.begin + end + 9 + 24 * COUNT.unpack_from(self.held, end + 1)[0]
        elif at >= 0 and table == "point3d" and at + 51 <= len(self.held):
            return place + 51 + 8 * COUNT.unpack_from(self.held, at + 43)[0]
        if table == "camera":
            model = self.number(place + 4, "i")
            if not 0 <= model < len(CAMERA_MODELS):
                raise ModelError(f"camera model {model}")
            return place + 24 + 8 * CAMERA_MODELS[model][1]
        if table == "image":
            place = self.end_of_text(place + 64)
            return place + 8 + 24 * self.number(place, "Q")
        return place + 51 + 8 * self.number(place + 43, "Q")


def ranges(path: str, table: str, split: int = SPLIT) -> list[tuple[int, int, int]]:
    """(begin, end, records) of parts of a binary file of about `split` bytes, cut between records."""
    size = paths.size_of(path)
    with paths.opened(path) as file:
        heads = Heads(file, size)
        count, place = heads.number(0, "Q"), 8
        if count >= 1 << 63:
            raise ModelError("a count that no signed number holds")
        out, begin, records = [], place, 0
        for _ in range(count):
            place = heads.after(table, place)
            records += 1
            if place > size:
                raise ModelError("unexpected end of file")
            if place - begin >= split:
                out.append((begin, place, records))
                begin, records = place, 0
    return [*out, (begin, place, records)] if records or not out else out


def record_count(path: str) -> int:
    """Records of a binary file, from its head."""
    with paths.opened(path) as file:
        return Bytes(file.read(8)).count()


def _lines(text: str) -> list[str]:
    """Lines without comments; blank lines stay, as an image without points has one."""
    return [x for x in text.split("\n") if not x.lstrip().startswith("#")]


def _text_cameras(text: str) -> Iterator[tuple]:
    for line in _lines(text):
        if not (t := line.split()):
            continue
        if len(t) < 5:
            raise ModelError(f"malformed camera line: {line}")
        yield int(t[0]), t[1], int(t[2]), int(t[3]), [float(x) for x in t[4:]]


def _text_images(text: str) -> Iterator[tuple]:
    rows = _lines(text)
    at = 0
    while at < len(rows):
        t = rows[at].split()
        if not t:
            at += 1
            continue
        if len(t) < 10:
            raise ModelError(f"malformed image line: {rows[at]}")
        p = rows[at + 1].split() if at + 1 < len(rows) else []
        if len(p) % 3:
            raise ModelError(f"odd point list of image {t[0]}")
        points = [(float(p[k]), float(p[k + 1]), _point_id(int(p[k + 2]))) for k in range(0, len(p), 3)]
        yield int(t[0]), [float(x) for x in t[1:5]], [float(x) for x in t[5:8]], int(t[8]), " ".join(t[9:]), points
        at += 2


def _point_id(value: int) -> int:
    return -1 if value == (1 << 64) - 1 else value


def _text_points(text: str) -> Iterator[tuple]:
    for line in _lines(text):
        if not (t := line.split()):
            continue
        if len(t) < 8 or len(t) % 2:
            raise ModelError(f"malformed point line: {line}")
        yield int(t[0]), [float(x) for x in t[1:4]], [int(x) for x in t[4:7]], float(t[7]), [(int(t[k]), int(t[k + 1])) for k in range(8, len(t), 2)]


TEXT = {"camera": _text_cameras, "image": _text_images, "point3d": _text_points}


@dataclass
class Part(InputPartition):
    """Some records of a table of one model: a range of a binary file, or a whole text file."""

    path: str
    begin: int = 0
    end: int = 0
    records: int = 0


class SfmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.folders, self.split = options.get("table", "image"), options["path"].split(","), int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def partitions(self) -> list[Part]:
        """Only heads of binary records are read here; a text file, whose records are lines, is one part."""
        out = []
        for folder in self.folders:
            stem = paths.joined(folder, TABLES[self.table][0])
            if model_format(folder) == "binary":
                out += [Part(stem + ".bin", *x) for x in ranges(stem + ".bin", self.table, self.split)]
            else:
                out.append(Part(stem + ".txt"))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path.endswith(".txt"):
            yield from TEXT[self.table](paths.text_of(partition.path))
            return
        with paths.opened(partition.path) as file:
            file.seek(partition.begin)
            data = Bytes(file.read(partition.end - partition.begin))
        for _ in range(partition.records):
            yield RECORD[self.table](data)


def _pack(table: str, row) -> bytes:
    if table == "camera":
        if row["model"] not in NUMBERS:
            raise ModelError(f"camera model {row['model']}")
        number, n = NUMBERS[row["model"]]
        if len(row["params"]) != n:
            raise ModelError(f"{row['model']} has {n} parameters, not {len(row['params'])}")
        return packing.pack(f"<iiQQ{n}d", row["camera_id"], number, row["width"], row["height"], *row["params"])
    if table == "image":
        head = packing.pack("<i7di", row["image_id"], *row["qvec"], *row["tvec"], row["camera_id"]) + row["name"].encode() + b"\0"
        return head + packing.pack("<Q", len(row["points2d"])) + b"".join(packing.pack("<ddq", p["x"], p["y"], p["point3d_id"]) for p in row["points2d"])
    head = packing.pack("<Q3d3Bd", row["point3d_id"], *row["xyz"], *row["rgb"], row["error"])
    return head + packing.pack("<Q", len(row["track"])) + b"".join(packing.pack("<ii", e["image_id"], e["point2d_idx"]) for e in row["track"])


@dataclass
class Written(WriterCommitMessage):
    """A task's part of a file: its first id orders the parts."""

    path: str
    records: int
    first: int


class SfmWriter(DataSourceWriter):
    """Writes one sorted, count-prefixed file: each task packs a range of ids to a part of its own, the commit puts the count and the parts together."""

    def __init__(self, options: dict, overwrite: bool):
        self.table, self.path, self.overwrite = options["table"], options["path"], overwrite
        self.parts = paths.joined(self.path, f".{TABLES[self.table][0]}-{uuid.uuid4().hex}")

    def write(self, rows) -> Written:
        context = TaskContext.get()
        target = paths.joined(self.parts, f"{context.partitionId()}-{context.taskAttemptId()}")
        records, first = 0, 0
        with paths.created(target) as file:
            for row in rows:
                if not records:
                    first = row[KEYS[self.table]]
                file.write(_pack(self.table, row))
                records += 1
        return Written(target, records, first)

    def commit(self, messages) -> None:
        target = paths.joined(self.path, TABLES[self.table][0] + ".bin")
        if paths.is_file(target) and not self.overwrite:
            paths.removed(self.parts)
            raise ModelError(f"{target} exists")
        found = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.first)
        with paths.created(target + ".part") as file:
            file.write(packing.pack("<Q", sum(m.records for m in found)))
            for m in found:
                with paths.opened(m.path) as part:
                    while data := part.read(WINDOW):
                        file.write(data)
        paths.removed(target)
        paths.renamed(target + ".part", target)
        paths.removed(self.parts)

    def abort(self, messages) -> None:
        paths.removed(self.parts)


class SfmSource(DataSource):
    """Options: path (a shared folder or address; several with commas), table (camera, image, point3d), splitBytes (of a binary file, a task)."""

    @classmethod
    def name(cls) -> str:
        return "sfm"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "image")][1]

    def reader(self, schema) -> SfmReader:
        return SfmReader(self.options)

    def writer(self, schema, overwrite: bool) -> SfmWriter:
        return SfmWriter(self.options, overwrite)


KEYS = {"camera": "camera_id", "image": "image_id", "point3d": "point3d_id"}


def read_model(spark: SparkSession, path: str, complete: bool = False) -> Model:
    """The three tables of a model. With complete, a model without cameras or images is an error."""
    if not paths.is_folder(path):
        raise ModelError(f"{path} is no folder")
    model_format(path)
    spark.dataSource.register(SfmSource)
    out = Model(*[spark.read.format("sfm").option("table", t).load(path) for t in TABLES])
    if complete and (out.cameras.isEmpty() or out.images.isEmpty()):
        raise ModelError("a model without cameras or images")
    return out


def write_model(model: Model, path: str, overwrite: bool = False) -> None:
    """Binary files, rows sorted by id: tasks pack ranges of ids, which the commit joins in order."""
    for table, df in (("camera", model.cameras), ("image", model.images), ("point3d", model.points)):
        df.sparkSession.dataSource.register(SfmSource)
        ready: DataFrame = df.select(*[f.name for f in struct(TABLES[table][1]).fields]).repartitionByRange(KEYS[table]).sortWithinPartitions(KEYS[table])
        ready.write.format("sfm").mode("overwrite" if overwrite else "append").option("table", table).save(path)
