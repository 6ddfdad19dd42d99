"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, the first by the hash of their id, and the characters of their texts at most: both bound what the driver holds.
FIT_ROWS, FIT_CHARS = 8_000, 256_000_000


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[list[str], list[int]]:
    """Whole texts and labels of up to `rows` labelled documents outside the held-out fold, in a fixed order: by the hash of the id, then id and text.

    An id with several labels takes the greatest. Rows that share an id are all candidates, so the bound is on rows and not on ids. Null labels and null ids teach nothing; null texts are empty. Further
    columns of either table are ignored, also those named alike. After `rows` rows, or before the row with which the texts would pass `chars`, the sample ends; it never cuts a text.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter(fold() % modulus != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    first = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(first), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    found = found.orderBy(*order).limit(rows)
    so_far = F.sum(F.length("text")).over(Window.orderBy(*order))
    table = found.withColumn("so_far", so_far).filter(F.col("so_far") <= chars).select("doc_id", "text", "y").toArrow()
    if not table.num_rows:
        return [], []
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table["text"].to_pylist(), table["y"].to_pylist()
