"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table
from .fingerprints import compare_neighbours
from .line_dedup import drop_site_boilerplate, page_texts
from .ngram_join import jaccard_components
from .packing import pack
from .quality_ftrl import score_quality
from .quality_mcd import BASE, base_failed, base_statistics, quality_rules
from .secrets import find_secrets
from .sharding import shard_by_bytes
from .spm import encode_pieces
from .toxicity import score_toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), window=1024, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), with_ids=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_site_boilerplate(page_texts(table(spark, sf_dir, "pages")), host="host")
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7_quality_rules, as its operator counts them."""
    return base_statistics(table(spark, sf_dir, "documents")).select("doc_id", *BASE, base_failed().alias("base_failed"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5_secrets."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def llm_queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_ngram_join": op4_ngram_join,
        "op5_secrets": op5_secrets,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_fingerprints": op8_fingerprints,
        "op9_pieces": op9_pieces,
        "op10_line_dedup": op10_line_dedup,
        "quality_base": quality_base,
        "secrets_base": secrets_base,
    }


def llm_oracle_sql() -> dict:
    return {
        "op2_sharding": sql.SHARDING,
        "op4_ngram_join": sql.NGRAMS,
        "op10_line_dedup": sql.LINES,
        "quality_base": sql.QUALITY_BASE,
        "secrets_base": sql.SECRETS_BASE,
    }
