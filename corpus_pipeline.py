"""Corpus preparation: quality rules, line dedup, near-duplicate removal, secret redaction, packing.

What all stages have in common: docs may have nulls in any column, repeated rows, and further columns of any name, which the stages do not hand on (all but the last return COLUMNS); texts of any
length are taken whole; an empty table gives an empty one. What a stage does with null and empty texts is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import materialise, table
from lodeframe.llm.line_dedup import drop_site_boilerplate
from lodeframe.llm.ngram_join import drop_near_duplicates
from lodeframe.llm.packing import pack
from lodeframe.llm.quality_mcd import keep_good
from lodeframe.llm.secrets import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go; these have null and empty texts among them. Null languages and sources are groups of their own; repeated rows are judged alike."""
    return keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over a tenth of a source's documents contain go; n_chars is counted anew. No document goes: null texts stay null with their n_chars, a text of boilerplate alone becomes empty. Null sources are one source; repeated
    rows count as documents of their own."""
    out = drop_site_boilerplate(docs, host="source", max_ratio=0.1, counts=None)
    return _counted(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, and of rows with that id the one with the least text. Texts without words (null, empty) and rows without an id stay."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes, and n_chars is counted anew. Null texts stay null with their n_chars."""
    return _counted(redact_secrets(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 1024 tokens with every source's share. Null and empty texts are an end mark alone; null sources are one source; repeated rows and rows without an id are packed as they stand."""
    return pack(docs, window=1024, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Near-duplicate components and token packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
