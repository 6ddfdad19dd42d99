"""Experiment results: placeholders, comparison, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RESULT, struct


def placeholders(manifests: DataFrame, status: str = "not_run", iterations: int = 30_000) -> DataFrame:
    """A result without metrics for each manifest."""
    given = {
        "experiment": F.col("experiment_name"), "selection_method": F.col("selection_method"), "training_budget": F.col("training_budget"), "train_image_count": F.col("train_image_count"),
        "test_image_count": F.col("test_image_count"), "iterations": F.lit(iterations), "status": F.lit(status), "warnings": F.array(),
    }
    return manifests.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(RESULT)])


def compare(results: DataFrame) -> DataFrame:
    return results.orderBy("experiment")


def csv_rows(results: DataFrame) -> DataFrame:
    """Results as their CSV has them: warnings in one cell."""
    return results.withColumn("warnings", F.concat_ws("; ", "warnings"))


def json_document(results: DataFrame, phase: int = 5) -> DataFrame:
    """One row with the results' JSON document, sorted by experiment, keys sorted, nulls kept."""
    columns = sorted(results.columns)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    each = results.select("experiment", row.alias("j")).agg(F.array_sort(F.collect_list(F.struct("experiment", "j"))).alias("rows"))
    return each.select(F.concat(F.lit('{"experiments":['), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit(f'],"phase":{phase}}}')).alias("document"))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A header and one file; nulls are empty cells. An existing path is an error unless overwrite."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
