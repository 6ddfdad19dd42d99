"""Video metadata from container headers, and the rules that a video must keep. Frames themselves need a codec and are decoded elsewhere."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths

VIDEO = "path string, fps double, total_frames bigint, width bigint, height bigint, duration_seconds double, rule string"


def _avi(file) -> tuple[float, int, int, int]:
    """(fps, frames, width, height) of the main header, which stands first in the file's header list."""
    head = file.read(4096)
    at = head.find(b"avih")
    if at < 0 or at + 8 + 40 > len(head):
        raise ValueError("no main header")
    micros, _, _, _, frames, _, _, _, width, height = struct.unpack("<10I", head[at + 8 : at + 48])
    return (1e6 / micros if micros else 0.0), frames, width, height


def _boxes(file, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes between two places, without reading their bodies."""
    while begin + 8 <= end:
        file.seek(begin)
        size, kind = struct.unpack(">I4s", file.read(8))
        inner = begin + 8
        if size == 1:
            size, inner = struct.unpack(">Q", file.read(8))[0], begin + 16
        elif size == 0:
            size = end - begin
        if size < inner - begin:
            raise ValueError("a box without room for its head")
        yield kind, inner, begin + size
        begin += size


def _inside(file, box: tuple[int, int], *kinds: bytes) -> tuple[int, int] | None:
    """The first box at a path of kinds."""
    for kind in kinds:
        box = next(((b, e) for k, b, e in _boxes(file, *box) if k == kind), None)
        if box is None:
            return None
    return box


def _mp4(file, size: int) -> tuple[float, int, int, int]:
    """(fps, frames, width, height) of the first video track: frames by the time-to-sample table, its ticks over the track's scale."""
    movie = _inside(file, (0, size), b"moov")
    for kind, begin, end in _boxes(file, *movie) if movie else ():
        handler = _inside(file, (begin, end), b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None:
            continue
        file.seek(handler[0] + 8)
        if file.read(4) != b"vide":
            continue
        track, scale, table = (_inside(file, (begin, end), *x) for x in ((b"tkhd",), (b"mdia", b"mdhd"), (b"mdia", b"minf", b"stbl", b"stts")))
        file.seek(track[1] - 8)
        width, height = (x >> 16 for x in struct.unpack(">II", file.read(8)))
        file.seek(scale[0])
        file.seek(scale[0] + (20 if file.read(1) == b"\1" else 12))
        (ticks_a_second,) = struct.unpack(">I", file.read(4))
        file.seek(table[0] + 4)
        (entries,) = struct.unpack(">I", file.read(4))
        flat = struct.unpack(f">{2 * entries}I", file.read(8 * entries))
        frames, ticks = sum(flat[::2]), sum(n * d for n, d in zip(flat[::2], flat[1::2], strict=True))
        return (frames * ticks_a_second / ticks if ticks else 0.0), frames, width, height
    raise ValueError("no video track")


def read_metadata(path: str) -> tuple[float, int, int, int]:
    """(fps, frames, width, height) of an AVI or MP4 file, from its headers alone."""
    with paths.opened(path) as file:
        head = file.read(12)
        file.seek(0)
        if head[:4] == b"RIFF" and head[8:] == b"AVI ":
            return _avi(file)
        if head[4:8] in (b"ftyp", b"moov"):
            return _mp4(file, paths.size_of(path))
    raise ValueError("no known container")


def video_rule(fps: Column, frames: Column, width: Column, height: Column) -> Column:
    """The first rule that a video breaks; null for a sound one."""
    return F.when(fps.isNull() | F.isnan(fps) | (fps <= 0), "fps").when(frames.isNull() | (frames <= 0), "frame count").when(F.coalesce((width <= 0) | (height <= 0), F.lit(True)), "dimensions")


def checked_videos(metadata: DataFrame) -> DataFrame:
    """metadata (path, fps, total_frames, width, height) with duration_seconds (null for an unsound video) and rule."""
    out = metadata.withColumn("rule", video_rule(F.col("fps"), F.col("total_frames"), F.col("width"), F.col("height")))
    return out.withColumn("duration_seconds", F.when(F.col("rule").isNull(), F.col("total_frames") / F.col("fps")))


def videos(spark: SparkSession, files: DataFrame | list[str]) -> DataFrame:
    """A row for each file (column path): its metadata, and the rule that it breaks (missing, container, fps, frame count, dimensions). Executors read headers only, in ranges."""
    listed = files.select("path") if isinstance(files, DataFrame) else spark.createDataFrame([(x,) for x in files], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                try:
                    rows.append((path, *read_metadata(path), None))
                except FileNotFoundError:
                    rows.append((path, None, None, None, None, "missing"))
                except (ValueError, TypeError, struct.error, OSError):
                    rows.append((path, None, None, None, None, "container"))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "fps", "total_frames", "width", "height", "opened"])

    out = checked_videos(listed.mapInArrow(run, "path string, fps double, total_frames bigint, width bigint, height bigint, opened string"))
    return out.select("path", "fps", "total_frames", "width", "height", "duration_seconds", F.coalesce("opened", "rule").alias("rule"))
