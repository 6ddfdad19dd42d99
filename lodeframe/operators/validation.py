"""Rules as tables of violations: a manifest or table is sound where they are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RESULT, STATUSES, struct


class Violation(ValueError):
    """A rule does not hold."""


def enforce(violations: DataFrame, message: str, shown: int = 10) -> None:
    """Raises with the first few violations, if there are any."""
    if found := violations.limit(shown).collect():
        raise Violation(f"{message}: {[r.asDict() for r in found]}")


def name_violations(df: DataFrame, scene: str, name: str = "name") -> DataFrame:
    """(scene, name, rule) of empty, absolute and repeated names."""
    n = F.col(name)
    bad = df.withColumn("rule", F.when(n.isNull() | (n == ""), "empty").when(n.startswith("/"), "absolute")).filter("rule is not null").select(scene, name, "rule").distinct()
    twice = df.groupBy(scene, name).count().filter("count > 1").select(scene, name, F.lit("repeated").alias("rule"))
    return bad.union(twice)


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Names on both sides."""
    return train.select(*keys).distinct().join(test.select(*keys).distinct(), keys, "left_semi")


def missing(requested: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return requested.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")


def latest_paths(files: DataFrame, base: str, path: str) -> DataFrame:
    """(base, path): of files with the same base name the path that sorts last."""
    return files.groupBy(base).agg(F.max(path).alias(path))


def source_files(names: DataFrame, files: DataFrame, name: str = "name", base: str = "base", path: str = "path") -> DataFrame:
    """names with the path of each one's file; null where there is none."""
    return names.join(latest_paths(files, base, path).withColumnRenamed(base, name), name, "left")


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """(experiment_name, rule) of manifests whose counts, lists or keys are wrong."""
    train, test = F.col("training_images"), F.col("test_images")
    rules = [
        (F.col("experiment_name").isNull() | F.col("selection_method").isNull() | train.isNull() | test.isNull() | F.col("total_scene_images").isNull(), "missing key"),
        ((F.size(train) == 0) | (F.size(test) == 0), "empty list"),
        (F.size(F.array_distinct(train)) != F.size(train), "repeated training image"),
        (F.size(F.array_distinct(test)) != F.size(test), "repeated test image"),
        (F.exists(F.concat(train, test), lambda x: x.startswith("/")), "absolute name"),
        (F.arrays_overlap(train, test), "training and test overlap"),
        (~F.col("train_image_count").eqNullSafe(F.size(train).cast("long")), "train_image_count"),
        (~F.col("test_image_count").eqNullSafe(F.size(test).cast("long")), "test_image_count"),
    ]
    return _violations(manifests, "experiment_name", rules)


def selection_violations(selected: DataFrame, candidates: DataFrame, keys: list[str], scene: str, budget: int) -> DataFrame:
    """(scene, rule) where selected rows are no candidates, or are not as many as the budget."""
    outside = selected.join(candidates, keys, "left_anti").select(scene, F.lit("not a candidate").alias("rule")).distinct()
    wrong = selected.groupBy(scene).count().filter(F.col("count") != budget).select(scene, F.lit("budget").alias("rule"))
    return outside.union(wrong)


def result_violations(results: DataFrame) -> DataFrame:
    """(experiment, rule) of results that break the result schema."""
    absent = [f.name for f in struct(RESULT) if f.name not in results.columns]
    if absent:
        return results.select(F.lit(None).cast("string").alias("experiment"), F.lit(f"missing keys {absent}").alias("rule")).limit(1)
    rules = [
        (F.col("experiment").isNull() | (F.col("experiment") == ""), "experiment"),
        (F.coalesce(F.col("train_image_count") < 0, F.lit(True)), "train_image_count"),
        (F.coalesce(F.col("test_image_count") <= 0, F.lit(True)), "test_image_count"),
        (F.coalesce(F.col("iterations") <= 0, F.lit(True)), "iterations"),
        (~F.coalesce(F.lower("status").isin(*STATUSES), F.lit(False)), "status"),
    ]
    return _violations(results, "experiment", rules)


def _violations(df: DataFrame, key: str, rules: list) -> DataFrame:
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("rule"))
