"""The queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, lattice, lm_scoring, mixing, quality, sharding, simhash, sql, substring_dedup, suffix_dedup, url_filter
from .common import written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeated_strings(_documents(spark, sf_dir)))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_documents(spark, sf_dir)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeated_passages(_documents(spark, sf_dir)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an uneven layout, 32 shards by source, to 40 even ones."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32))
    return sharding.digest(sharding.resharded(_documents(spark, sf_dir), old, 32, 40))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")  # the vocabulary of byte_bpe_50k.tiktoken, as the library reads it
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return byte_bpe.digest(byte_bpe.decoded(byte_bpe.encoded(docs, path), path))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judged(_documents(spark, sf_dir)))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.digest(lm_scoring.scored(_documents(spark, sf_dir)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of `labels` stand for the page of the same number; low quality is a bad outcome."""
    outcomes = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return url_filter.digest(url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes))


def op9_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.digest(lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted once; texts don't travel."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.digest(mixing.mixed(written(docs), size_col="size"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_sharding, op3_byte_bpe, op4_quality_rules, op5_simhash_near_dedup, op6_substring_dedup, op7_lm_scoring, op8_url_filter, op9_lattice_near_dedup, op10_source_mixing)}
#: The others: fingerprints, merges of a vocabulary, and hashes that choose shards are beyond SQL.
SQL: dict[str, str] = {
    "op1_suffix_array_dedup": sql.SUFFIX_DEDUP,
    "op4_quality_rules": quality.SQL,
    "op6_substring_dedup": sql.SUBSTRING_DEDUP,
    "op7_lm_scoring": lm_scoring.SQL,
    "op8_url_filter": sql.URL_FILTER,
    "op9_lattice_near_dedup": sql.LATTICE_DEDUP,
    "op10_source_mixing": mixing.SQL,
}
