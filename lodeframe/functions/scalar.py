"""Column expressions: geometry, quality scores, motion, metrics, naming."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rotation(q: Column) -> Column:
    """3x3 rotation of a quaternion (w, x, y, z), which is not normalised first."""
    w, x, y, z = (F.get(q, k) for k in range(4))
    rows = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    return F.array(*[F.array(*row) for row in rows])


def camera_center(q: Column, t: Column) -> Column:
    """Minus the transposed rotation times t."""
    r = rotation(q)
    return F.array(*[-(r[0][k] * F.get(t, 0) + r[1][k] * F.get(t, 1) + r[2][k] * F.get(t, 2)) for k in range(3)])


def norm3(v: Column) -> Column:
    return F.sqrt(F.get(v, 0) * F.get(v, 0) + F.get(v, 1) * F.get(v, 1) + F.get(v, 2) * F.get(v, 2))


def viewing_direction(q: Column) -> Column:
    """The rotation's third row at unit length; (0, 0, 1) where it has none."""
    row = rotation(q)[2]
    size = norm3(row)
    return F.when(size == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(*[F.try_divide(row[k], size) for k in range(3)]))


def quality_score(valid: Column, blur: Column, brightness: Column, dark: Column, bright: Column) -> Column:
    """Sharpness 0.4, exposure 0.4, clipping 0.2; 0 for invalid rows, and a missing signal never lowers the score."""
    sharp = F.when(blur.isNull(), 1.0).otherwise(clamp01(blur / 1000))
    exposure = F.when(brightness.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(brightness - 128) / 128))
    clipped = F.greatest(F.lit(0.0), 1 - F.greatest(F.coalesce(dark, F.lit(0.0)), F.coalesce(bright, F.lit(0.0))))
    return F.when(valid, clamp01(0.4 * sharp + 0.4 * exposure + 0.2 * clipped)).otherwise(0.0)


def feature_score(valid: Column, features: Column) -> Column:
    return F.when(features.isNull(), F.when(valid, 0.5).otherwise(0.0)).otherwise(clamp01(features / 1500))


def pose_distance(ca: Column, cb: Column, da: Column, db: Column, oa: Column, ob: Column, scale: Column, sequence: Column) -> Column:
    """0.55 of the centres' distance, 0.30 of the directions' angle, 0.15 of the places' distance; a missing pose adds nothing."""
    gap = F.sqrt((F.get(ca, 0) - F.get(cb, 0)) ** 2 + (F.get(ca, 1) - F.get(cb, 1)) ** 2 + (F.get(ca, 2) - F.get(cb, 2)) ** 2)
    dot = F.get(da, 0) * F.get(db, 0) + F.get(da, 1) * F.get(db, 1) + F.get(da, 2) * F.get(db, 2)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) / math.pi
    place = F.abs(oa - ob) / F.greatest(F.lit(1.0), sequence)
    return F.coalesce(0.55 * F.least(F.lit(1.0), gap / scale), F.lit(0.0)) + F.coalesce(0.30 * turn, F.lit(0.0)) + 0.15 * place


def quality_class(blur: Column, mean: Column, dark: Column, bright: Column, blur_threshold=100.0, min_brightness=30.0, max_brightness=225.0, max_dark=0.45, max_bright=0.45) -> Column:
    """The first reason that holds, or selected. An undecodable image, with null statistics, is invalid_image."""
    return (
        F.when(blur.isNull() | mean.isNull(), "invalid_image")
        .when(blur < blur_threshold, "blur")
        .when((mean < min_brightness) | (dark > max_dark), "underexposed")
        .when((mean > max_brightness) | (bright > max_bright), "overexposed")
        .otherwise("selected")
    )


def fit_inside(width: Column, height: Column, max_width: int, max_height: int) -> tuple[Column, Column]:
    """Size that keeps the aspect, never enlarges, and rounds halves to even."""
    scale = F.least(max_width / width, max_height / height, F.lit(1.0))
    return tuple(F.greatest(F.lit(1), F.bround(x * scale).cast("long")) for x in (width, height))


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%06d.jpg", number)


def mse(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def psnr(a: Column, b: Column, peak: float = 1.0) -> Column:
    """20 log10(peak) - 10 log10(mse); infinite for equal signals, an error for different sizes."""
    error = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signals of different sizes"))).otherwise(mse(a, b))
    return F.when(error == 0, F.lit(float("inf"))).otherwise(20 * math.log10(peak) - 10 * F.log10(error))


def motion_penalty(motion: Column, max_motion: float) -> Column:
    return F.when(motion.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), motion / max(max_motion, 1e-9))))


def similarity(reliable: Column, na: Column, nb: Column, penalty: Column) -> Column:
    return F.least(F.lit(1.0), reliable / F.greatest(F.lit(1), F.least(na, nb))) * penalty


def redundant(matches: Column, score: Column, motion: Column, min_matches: int, threshold: float, max_motion: float) -> Column:
    return (matches >= min_matches) & (score >= threshold) & (motion.isNull() | (motion <= max_motion))


def registration_rate(registered: Column, total: Column) -> Column:
    return F.try_divide(registered, total)


def valid_point(point: Column) -> Column:
    """Missing points are -1, which also is 2^64 - 1 read as a signed number."""
    return point.isNotNull() & (point != -1)


def experiment_name_valid(name: Column) -> Column:
    return F.coalesce(name.rlike("^(full|(fixed|automatic)_0*[1-9][0-9]*)$"), F.lit(False))


def _one_decimal(x: Column) -> Column:
    """Text of a double with one decimal, rounded as the double stands (not as its shortest text does), ties to even. From 2^53 on a double has no decimals."""
    size = F.abs(x)
    # counted in parts of 2^-58, which are exact but for less than 1/64, where the decimal is 0 anyway
    scaled = ((size - F.floor(size)) * float(1 << 58)).cast("long") * 10
    tenths, rest = F.shiftright(scaled, 58), F.pmod(scaled, F.lit(1 << 58))
    tenths += ((rest > 1 << 57) | ((rest == 1 << 57) & (tenths % 2 == 1))).cast("int")
    whole = F.floor(size) + F.floor(tenths / 10)
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(size < float(1 << 53), text).otherwise(F.format_string("%.1f", x))


def human_bytes(n: Column, largest: str = "TB") -> Column:
    """Bytes with one decimal, in the first of B, KB, MB, GB, TB below 1024, or in the largest asked for; null for null."""
    units = ("B", "KB", "MB", "GB", "TB")
    value, out, last = n.cast("double"), F.when(n.isNull(), None), units.index(largest)
    for k, unit in enumerate(units[: last + 1]):
        part = value / 1024.0**k
        text = F.concat(_one_decimal(part), F.lit(f" {unit}"))
        out = out.when(part < 1024, text) if k < last else out.otherwise(text)
    return out


def utc_text(at: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC, whole seconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def utc_now() -> Column:
    return utc_text(F.current_timestamp())


def json_safe(x: Column) -> Column:
    """JSON text of a double: infinities as strings, not-a-number as null."""
    return (
        F.when(x.isNull() | F.isnan(x), "null")
        .when(x == float("inf"), '"inf"')
        .when(x == float("-inf"), '"-inf"')
        .otherwise(F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))
    )


def first_last_loss(log: Column) -> tuple[Column, Column]:
    """First and last value of Loss=, not of Depth Loss=; null with under two values."""
    found = F.filter(F.transform(F.regexp_extract_all(log, F.lit(r"(?<!Depth )Loss=([0-9eE+\-.]+)"), F.lit(1)), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    enough = F.size(found) >= 2
    return F.when(enough, F.get(found, 0)), F.when(enough, F.element_at(found, -1))


def ply_vertices(header: Column) -> Column:
    """The number after `element vertex` in a header; null where the header has none before its end."""
    head = F.regexp_extract(header, r"(?s)^(.*?)end_header", 1)
    return F.regexp_extract(head, r"element vertex ([0-9]+)", 1).try_cast("long")
