"""Nearest neighbours, ratio and mutual tests, and frame comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two arrays of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Left rows of a block that one task compares with the block's right rows, and rows in a tile of distances.
LEFT_ROWS, TILE = 4096, 512


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between two sets of vectors; for squares by a matrix product, so they are off by rounding."""
    if metric == "hamming":
        out = np.zeros((len(a), len(b)), np.int64)
        for k in range(a.shape[1]):
            out += np.bitwise_count(a[:, k : k + 1] ^ b[:, k])
        return out.astype(float)
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int, metric: str = "squared") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a the places of its k nearest rows of b and the exact distances, ties by place."""
    for begin in range(0, len(a) if len(b) else 0, TILE):
        tile = a[begin : begin + TILE]
        d = _distances(tile, b, metric)
        kth = np.partition(d, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        slack = 0.0 if metric == "hamming" else 1e-9 * (1.0 + np.abs(kth) + (tile * tile).sum(1))
        for i, near in enumerate(d <= (kth + slack)[:, None]):
            place = np.flatnonzero(near)
            exact = d[i, place] if metric == "hamming" else ((tile[i] - b[place]) ** 2).cumsum(1)[:, -1]
            order = np.argsort(exact, kind="stable")[:k]
            yield begin + i, place[order], exact[order]


def nearest(left: DataFrame, right: DataFrame, block: str, metric: str = "squared", k: int = 2) -> DataFrame:
    """The k nearest right rows of each left row in its block: (block, a, b, d, rank), ties by b. metric: squared (of numbers) or hamming (bits of whole numbers).

    left and right have block, id and v (arrays of one length). A task holds a block's right rows and up to LEFT_ROWS left ones or so and compares them tile by tile; a block
    with more left rows is dealt over as many tasks as that takes.
    """
    if metric not in ("squared", "hamming"):
        raise ValueError(metric)
    kinds = dict(left.dtypes)
    parts = left.groupBy(block).agg(F.ceil(F.count("*") / LEFT_ROWS).cast("int").alias("parts"))
    own = left.join(parts, block).select(block, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "v")
    other = right.join(parts, block).select(block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
    # the sides may come from one table: their columns are made different ones
    own, other = own.toDF("block", "part", "id", "v"), other.toDF("other", "dealt", "id", "v")
    number = np.int64 if metric == "hamming" else float

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (block, "a", "b", "d", "rank")})
        b = b.sort_values("id", kind="stable")
        x, y = (np.stack([np.asarray(v, number) for v in p["v"]]) for p in (a, b))
        ids, others, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        for i, place, d in nearest_rows(x, y, k, metric):
            out += [(ids[i], others[p], value, r + 1) for r, (p, value) in enumerate(zip(place, d, strict=True))]
        found = pd.DataFrame(out, columns=["a", "b", "d", "rank"])
        found.insert(0, block, a["block"].iloc[0])
        return found

    schema = f"`{block}` {kinds[block]}, a {kinds['id']}, b {dict(right.dtypes)['id']}, d double, rank int"
    return own.groupBy("block", "part").cogroup(other.groupBy("other", "dealt")).applyInPandas(run, schema)


def in_distance_order(matches: DataFrame, block: str) -> DataFrame:
    """matches with their place by distance in their block, from 0; equal ones by a and b. A block's matches are at most its left rows."""
    return matches.withColumn("position", (F.row_number().over(Window.partitionBy(block).orderBy("d", "a", "b")) - 1).cast("long"))


def ratio_matches(neighbours: DataFrame, block: str, ratio: float = 0.75) -> DataFrame:
    """(block, a, b, d) where the nearest is under `ratio` of the second nearest; a row with one neighbour has no match."""
    best = neighbours.groupBy(block, "a").agg(F.min_by("b", "rank").alias("b"), F.min_by("d", "rank").alias("d"), F.max_by("d", "rank").alias("second"), F.count("*").alias("n"))
    return best.filter((F.col("n") == 2) & (F.col("d") < ratio * F.col("second"))).select(block, "a", "b", "d")


def mutual_matches(forward: DataFrame, backward: DataFrame, block: str, most: float) -> DataFrame:
    """(block, a, b, d) of pairs that are each other's nearest, at most `most` apart."""
    f = forward.filter("rank = 1").select(block, "a", "b", "d")
    b = backward.filter("rank = 1").select(block, F.col("a").alias("b"), F.col("b").alias("a"))
    return f.join(b, [block, "a", "b"]).filter(F.col("d") <= most)


def orb_matches(ratio: DataFrame, mutual: DataFrame, block: str, minimum: int) -> DataFrame:
    """Ratio matches; in blocks with fewer than `minimum`, the mutual ones instead if there are more of them."""
    counts = ratio.groupBy(block).agg(F.count("*").alias("r")).join(mutual.groupBy(block).agg(F.count("*").alias("m")), block, "full")
    use = counts.select(block, ((F.coalesce("r", F.lit(0)) < minimum) & (F.coalesce("m", F.lit(0)) > F.coalesce("r", F.lit(0)))).alias("mutual"))
    return ratio.join(use.filter("not mutual"), block, "left_semi").union(mutual.join(use.filter("mutual"), block, "left_semi"))


def median_motion(matches: DataFrame, block: str, diagonal: Column, xa: str = "xa", ya: str = "ya", xb: str = "xb", yb: str = "yb") -> DataFrame:
    """(block, motion): median distance between matched points over the image diagonal."""
    gap = F.sqrt((F.col(xa) - F.col(xb)) ** 2 + (F.col(ya) - F.col(yb)) ** 2)
    return matches.groupBy(block).agg(F.median(gap / diagonal).alias("motion"))


def all_pairs(df: DataFrame, scene: str, index: str) -> DataFrame:
    """(scene, a, b) with a < b: exhaustive pair matching, whose output is every pair of a scene by definition."""
    left, right = df.select(scene, F.col(index).alias("a")), df.select(scene, F.col(index).alias("b"))
    return left.join(right, scene).filter("a < b")


def window_pairs(df: DataFrame, scene: str, index: str, overlap: int = 10) -> DataFrame:
    """(scene, a, b) with 0 < b - a <= overlap: sequential pair matching, joined on blocks of `overlap` places instead of an inequality alone."""
    block = F.floor(F.col(index) / overlap)
    left = df.select(scene, F.col(index).alias("a"), F.explode(F.array(block, block + 1)).alias("__block"))
    right = df.select(scene, F.col(index).alias("b"), block.alias("__block"))
    return left.join(right, [scene, "__block"]).filter((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + overlap)).select(scene, "a", "b")


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homogeneous points moved to their centre and scaled to a mean distance of the root of 2, and the matrix that does it."""
    c = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
    t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1.0]])
    return np.c_[p, np.ones(len(p))] @ t.T, t


def _epipolar(a: np.ndarray, b: np.ndarray, threshold: float, rounds: int, rng: np.random.Generator) -> int:
    """Most matches within `threshold` of their epipolar lines, by the eight-point method over random samples."""
    (pa, ta), (pb, tb) = _normalised(a), _normalised(b)
    ha, hb, best = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))], 0
    for _ in range(rounds):
        k = rng.choice(len(a), 8, replace=False)
        m = np.stack([pb[k, i] * pa[k, j] for i in range(3) for j in range(3)], 1)
        u, s, v = np.linalg.svd(np.linalg.svd(m)[2][-1].reshape(3, 3))
        if s[1] < 1e-12:
            continue
        f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ v) @ ta
        lb, la = ha @ f.T, hb @ f
        r = np.abs((hb * lb).sum(1))
        d = np.maximum(r / np.maximum(np.hypot(lb[:, 0], lb[:, 1]), 1e-12), r / np.maximum(np.hypot(la[:, 0], la[:, 1]), 1e-12))
        best = max(best, int((d <= threshold).sum()))
    return best


def _planar(a: np.ndarray, b: np.ndarray, threshold: float, rounds: int, rng: np.random.Generator) -> int:
    """Most matches that a homography takes to within `threshold` of their partner, by direct linear solution over random samples of four."""
    (pa, ta), (pb, tb) = _normalised(a), _normalised(b)
    ha, best = np.c_[a, np.ones(len(a))], 0
    for _ in range(rounds):
        rows = []
        for x, y in ((pa[i], pb[i]) for i in rng.choice(len(a), 4, replace=False)):
            rows += [np.r_[np.zeros(3), -x, y[1] * x], np.r_[x, np.zeros(3), -y[0] * x]]
        h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
        to = ha @ h.T
        there = np.abs(to[:, 2]) > 1e-12
        gap = np.full(len(a), np.inf)
        gap[there] = np.hypot(*(to[there, :2] / to[there, 2:] - b[there]).T)
        best = max(best, int((gap <= threshold).sum()))
    return best


def inlier_count(a: np.ndarray, b: np.ndarray, threshold: float = 3.0, rounds: int = 200, seed: int = 0) -> int | None:
    """Matches that agree with the best fundamental matrix; where none has the eight that it takes, with the best homography; null under eight matches or where
    none fits. The samples are drawn from a fixed seed, so equal matches have equal counts."""
    if len(a) < 8:
        return None
    a, b, rng = np.asarray(a, float), np.asarray(b, float), np.random.default_rng(seed)
    best = _epipolar(a, b, threshold, rounds, rng)
    if best < 8:
        best = _planar(a, b, threshold, rounds, rng)
    return best if best >= 4 else None


def geometric_inliers(matches: DataFrame, block: str, threshold: float = 3.0, rounds: int = 200) -> DataFrame:
    """(block, matches, inliers) of matched points (block, xa, ya, xb, yb): one task a block, whose matches are at most the detector's maximum."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["xa", "ya", "xb", "yb"], kind="stable")
        found = inlier_count(part[["xa", "ya"]].to_numpy(), part[["xb", "yb"]].to_numpy(), threshold, rounds)
        return pd.DataFrame({block: [part[block].iloc[0]], "matches": [len(part)], "inliers": pd.array([found], dtype="Int64")})

    return matches.select(block, "xa", "ya", "xb", "yb").groupBy(block).applyInPandas(run, f"`{block}` {dict(matches.dtypes)[block]}, matches long, inliers long")
