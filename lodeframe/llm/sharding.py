"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import input_partitions, materialise

#: A group of equal texts above this part of a shard is cut at a row; a smaller one stays whole.
WHOLE_UP_TO = 0.05


def shard_by_bytes(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Puts every row of docs into one of `shards` contiguous shards of nearly equal bytes.

    Size: UTF-8 bytes of the text (null: none) plus 8. Rows are ordered by the text's MD5 hash and the id, so equal
    texts are neighbours. A group of up to WHOLE_UP_TO of a shard's bytes goes whole to the shard in which it begins, which moves a boundary by less than that part;
    a larger group is cut at the row where a target falls, since no law on sizes could hold with it whole. Both are the same prefix sum, taken at the group's or
    at the row's start. Returns doc_id, size, text_crc32, shard, slot (from 0, without gaps, in each shard).

    Null texts are empty texts: size 8, checksum 0. Null ids come first in their group; repeated rows have a slot each. Texts of any length count whole. An empty table gives
    no rows. Other columns, whatever their names, are ignored.

    Only (id, size, checksum, hash) is shuffled. The byte prefix is the partition's base, summed over the partitions' totals, plus a running sum inside
    the partition. Rows of a large group are dealt by id, and equal ones by row, so no partition has to hold it.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    slim = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(value) + 8).cast("long").alias("size"),
            F.crc32(value).alias("text_crc32"),
            F.md5(value.cast("binary")).alias("h"),
        ),
        "shard-slim",
    )
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # at most shards / WHOLE_UP_TO groups can be so large
    large = slim.groupBy("h").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > WHOLE_UP_TO * total / shards).select("h", F.lit(True).alias("large"))
    rows = slim.join(F.broadcast(large), "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    dealt = {"by_id": F.when(F.col("large"), F.col("doc_id")), "by_row": F.when(F.col("large"), F.monotonically_increasing_id())}
    rows = rows.withColumns(dealt).repartitionByRange(input_partitions(spark), "h", "by_id", "by_row").drop(*dealt)
    rows = materialise(rows.withColumn("pid", F.spark_partition_id()), "shard-rows")

    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("pid").agg(F.sum("size").alias("bytes")).select("pid", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid").orderBy("h", "doc_id")
    placed = rows.join(base, "pid").withColumn("end", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("size")
    cut = F.when(F.col("large"), start).otherwise(F.min(start).over(Window.partitionBy("pid", "h")))
    placed = placed.withColumn("at", cut).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"at * {shards} div {total}L")).cast("int"))
    placed = placed.withColumn("own", F.row_number().over(Window.partitionBy("pid", "shard").orderBy("h", "doc_id")))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "own", "pid"), "shard-placed")
    counts = placed.groupBy("shard", "pid").count()
    ahead = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", "pid", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    return placed.join(slots, ["shard", "pid"]).select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("own") - 1).cast("long").alias("slot"))
