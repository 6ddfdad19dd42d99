"""Corners and binary descriptors of gray images, and the comparison of two frames by them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .matching import inlier_count, nearest_rows

#: The circle of radius 3 around a pixel, in order (fixed values).
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))
#: Neighbouring circle pixels that must all be brighter or all darker, by how much, and the distance of corners from the border.
ARC, CONTRAST, BORDER = 9, 20, 19
#: Pairs of pixels that a descriptor compares, drawn once from a normal distribution inside a disc.
PAIRS = 256


def _pattern() -> np.ndarray:
    found = np.random.default_rng(256).normal(0, 5.0, (PAIRS, 2, 2))
    size = np.hypot(found[..., 0], found[..., 1])[..., None]
    return found * np.minimum(1.0, 12.0 / np.maximum(size, 1e-9))


PATTERN = _pattern()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1, of the image's size."""
    padded = np.pad(x.astype(float), r, mode="edge")
    c = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / n**2


def detect(gray: np.ndarray, maximum: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """(points, descriptors) of the `maximum` strongest corners: x and y, and 256 bits as four 64-bit numbers.

    A corner has ARC neighbouring circle pixels that are all brighter or all darker than it (segment test); of touching ones the strongest stays. A
    descriptor compares pairs of smoothed pixels, turned by the direction of the patch's intensity centroid. Images without room for a patch have none.
    """
    none = np.zeros((0, 2)), np.zeros((0, 4), np.uint64)
    h, w = gray.shape
    if maximum <= 0 or min(h, w) <= 2 * BORDER:
        return none
    g = gray.astype(np.int16)
    inner = g[3:-3, 3:-3]
    ring = np.stack([g[3 + y : h - 3 + y, 3 + x : w - 3 + x] for y, x in CIRCLE]) - inner
    corner = np.zeros(inner.shape, bool)
    for side in (ring > CONTRAST, ring < -CONTRAST):
        run = np.concatenate([side, side[: ARC - 1]])
        corner |= np.any([np.all(run[k : k + ARC], 0) for k in range(16)], 0)
    score = np.where(corner, np.maximum(np.abs(ring).astype(np.int32) - CONTRAST, 0).sum(0), 0)
    around = np.pad(score, 1)
    top = np.max([around[1 + y : 1 + y + score.shape[0], 1 + x : 1 + x + score.shape[1]] for y in (-1, 0, 1) for x in (-1, 0, 1)], 0)
    ys, xs = np.nonzero((score > 0) & (score == top))
    keep = (ys + 3 >= BORDER) & (ys + 3 < h - BORDER) & (xs + 3 >= BORDER) & (xs + 3 < w - BORDER)
    ys, xs = ys[keep], xs[keep]
    best = np.lexsort((xs, ys, -score[ys, xs]))[:maximum]
    ys, xs = ys[best] + 3, xs[best] + 3
    if not len(ys):
        return none
    smooth = _box(gray, 2)
    dy, dx = np.mgrid[-15:16, -15:16]
    disc = dy * dy + dx * dx <= 225
    patch = g[ys[:, None] + dy[disc], xs[:, None] + dx[disc]]
    angle = np.arctan2((patch * dy[disc]).sum(1), (patch * dx[disc]).sum(1))
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    px = np.rint(c * PATTERN[..., 0] - s * PATTERN[..., 1]).astype(int) + xs[:, None, None]
    py = np.rint(s * PATTERN[..., 0] + c * PATTERN[..., 1]).astype(int) + ys[:, None, None]
    value = smooth[py, px]
    bits = np.packbits(value[..., 0] < value[..., 1], axis=1, bitorder="little")
    return np.stack([xs, ys], 1).astype(float), bits.view("<u8")


@dataclass(frozen=True)
class Comparison:
    """Two frames held against each other."""

    match_count: int
    similarity_score: float | None
    median_motion_ratio: float | None
    geometric_inlier_count: int | None
    redundant: bool


@dataclass(frozen=True)
class Rules:
    """Settings of a comparison."""

    lowe_ratio: float = 0.75
    minimum_matches: int = 50
    minimum_features: int = 40
    redundancy_threshold: float = 0.85
    max_motion: float = 0.015
    geometric_check: bool = True
    ransac_threshold: float = 3.0
    mutual_distance: int = 32
    maximum_features: int = 3000


def match(a: np.ndarray, b: np.ndarray, rules: Rules) -> list[tuple[int, int, float]]:
    """(place in a, place in b, distance), by distance: ratio matches or, where they are under the minimum, mutual ones if there are more of them."""
    if len(a) < 2 or len(b) < 2:
        return []
    x, y = a.view(np.int64), b.view(np.int64)
    ahead = {i: (place, d) for i, place, d in nearest_rows(x, y, 2, "hamming")}
    found = [(i, int(place[0]), float(d[0])) for i, (place, d) in ahead.items() if d[0] < rules.lowe_ratio * d[1]]
    if len(found) < rules.minimum_matches:
        back = {j: int(place[0]) for j, place, _ in nearest_rows(y, x, 1, "hamming")}
        mutual = [(i, int(place[0]), float(d[0])) for i, (place, d) in ahead.items() if back[int(place[0])] == i and d[0] <= rules.mutual_distance]
        if len(mutual) > len(found):
            found = mutual
    return sorted(found, key=lambda m: m[2])


def compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], rules: Rules) -> Comparison:
    """The later frame b, of shape (height, width), against a. A side with too few features compares with nothing and is never redundant."""
    if min(len(a[0]), len(b[0])) < rules.minimum_features:
        return Comparison(0, None, None, None, False)
    matches = match(a[1], b[1], rules)
    if not matches:
        return Comparison(0, 0.0, None, None, False)
    i, j, _ = zip(*matches, strict=True)
    pa, pb = a[0][list(i)], b[0][list(j)]
    inliers = inlier_count(pa, pb, rules.ransac_threshold) if rules.geometric_check else None
    motion = float(np.median(np.hypot(*(pa - pb).T))) / math.hypot(*shape)
    overlap = min(1.0, (len(matches) if inliers is None else inliers) / max(1, min(len(a[0]), len(b[0]))))
    score = overlap * max(0.0, 1.0 - min(1.0, motion / max(rules.max_motion, 1e-9)))
    alike = len(matches) >= rules.minimum_matches and score >= rules.redundancy_threshold and motion <= rules.max_motion
    return Comparison(len(matches), score, motion, inliers, alike)
