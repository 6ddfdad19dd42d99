"""Deterministic sampling and splitting of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def positions(df: DataFrame, scene: str | list[str], order: str | list[str], name: str = "position") -> DataFrame:
    """df with the place of each row in its scene, from 0. A scene is sorted in one task; scenes spread over the cluster."""
    scene, order = _lists(scene, order)
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*scene).orderBy(*order)) - 1).cast("long"))


def _lists(*columns: str | list[str]) -> list[list[str]]:
    return [[c] if isinstance(c, str) else list(c) for c in columns]


def range_positions(df: DataFrame, scene: str | list[str], order: str | list[str], name: str = "position", total: str | None = None) -> DataFrame:
    """positions() for scenes that are too large for a task: rows are dealt by ranges of (scene, order), written once to the shared folder and numbered within their range; what
    earlier ranges hold of the scene comes before. Only counts by (range, scene) meet in one place. With total, the scene's rows are a column too. Rows of equal order are numbered in any order."""
    scene, order = _lists(scene, order)
    dealt = materialise(df.repartitionByRange(*scene, *order).withColumn("__range", F.spark_partition_id()), "positions")
    counts = dealt.groupBy(*scene, "__range").agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*scene).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(scene)], F.col("__range").alias("__r"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(*scene)).alias("__total"))
    same = F.col("__range") == F.col("__r")
    for k, c in enumerate(scene):
        same &= F.col(c).eqNullSafe(F.col(f"__{k}"))
    inside = F.row_number().over(Window.partitionBy("__range", *scene).orderBy(*order)) - 1
    out = dealt.withColumn("__inside", inside).join(before, same)
    return out.select(*df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(name), *([F.col("__total").alias(total)] if total else []))


def sequence_ends(df: DataFrame, scene: str, order: str | list[str], value: str) -> DataFrame:
    """(scene, first, last): the values at both ends of each ordered scene, without sorting it."""
    place = F.struct(*([order] if isinstance(order, str) else order))
    return df.groupBy(scene).agg(F.min_by(value, place).alias("first"), F.max_by(value, place).alias("last"))


def distinct_sorted(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, values): the different values of each group, sorted."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("values"))


def check_strategy(interval: int | None = None, seconds: float | None = None, target: int | None = None) -> None:
    """Exactly one strategy, and a positive one."""
    given = [x for x in (interval, seconds, target) if x is not None]
    if len(given) != 1:
        raise ValueError("exactly one of interval, seconds and target is needed")
    if given[0] <= 0:
        raise ValueError("the sampling strategy must be positive")


def time_step(fps: Column, seconds: float) -> Column:
    """Frames between samples: seconds * fps, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.lit(seconds) * fps).cast("long"))


def stride_indices(total: Column, step: Column) -> Column:
    return F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, step.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def even_indices(total: Column, target: int) -> Column:
    """Up to `target` indices from 0 to total - 1 at even distances, halves to even, without repeats."""
    count = F.least(F.lit(target).cast("long"), total.cast("long"))
    spread = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.bround(i * (total - 1) / (count - 1)).cast("long"))
    return F.when(count <= 0, F.array().cast("array<bigint>")).when(count == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(spread)))


def select_frames(videos: DataFrame, total: str = "total_frames", fps: str = "fps", interval: int | None = None, seconds: float | None = None, target: int | None = None) -> DataFrame:
    """videos exploded to frame_index, by one strategy."""
    check_strategy(interval, seconds, target)
    n = F.col(total)
    if target is not None:
        found = even_indices(n, target)
    else:
        found = stride_indices(n, F.lit(interval) if interval is not None else time_step(F.col(fps), seconds))
    return videos.withColumn("frame_index", F.explode(found))


def heldout_split(df: DataFrame, scene: str | list[str], order: str | list[str], interval: int = 8, offset: int = 0, large: bool = False) -> DataFrame:
    """df with position and is_test: every interval-th row of a scene, from offset. large: scenes don't fit a task (range_positions)."""
    if interval <= 1 or not 0 <= offset < interval:
        raise ValueError("interval must exceed 1 and offset lie in [0, interval)")
    return (range_positions if large else positions)(df, scene, order).withColumn("is_test", F.col("position") % interval == offset)


def uniform_budget(df: DataFrame, scene: str | list[str], order: str | list[str], budget: int, strict: bool = True, large: bool = False) -> DataFrame:
    """`budget` rows of each scene at even distances, ends included, halves up on integers; one row is the middle.

    A scene with fewer rows is an error, or with strict=False gives all of its rows. large: scenes don't fit a task (range_positions).
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    scene, order = _lists(scene, order)
    if large:
        rows = range_positions(df, scene, order, total="__n")
    else:
        rows = positions(df, scene, order).withColumn("__n", F.count("*").over(Window.partitionBy(*scene)))
    n, p = F.col("__n"), F.col("position")
    if strict:
        n = F.when(n < budget, F.raise_error(F.lit("the budget exceeds a scene's rows"))).otherwise(n)
    if budget == 1:
        keep = p == F.floor(n / 2)
    else:
        # the i-th index is (i (n - 1) + (b - 1) div 2) div (b - 1): position p is hit iff some i maps to it
        i = F.ceil((p * (budget - 1) - (budget - 1) // 2) / F.greatest(n - 1, F.lit(1)))
        index = F.floor((i * (n - 1) + (budget - 1) // 2) / (budget - 1))
        keep = (n <= budget) | ((i >= 0) & (i < budget) & (index == p))
    return rows.filter(keep).drop("__n")


def training_candidates(split: DataFrame) -> DataFrame:
    return split.filter(~F.col("is_test"))


def fixed_budget(split: DataFrame, scene: str | list[str], budget: int, strict: bool = True, large: bool = False) -> DataFrame:
    """uniform_budget over the training candidates of a heldout_split."""
    rows = training_candidates(split).withColumnRenamed("position", "order_index")
    return uniform_budget(rows, scene, "order_index", budget, strict, large)
