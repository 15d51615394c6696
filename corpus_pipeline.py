"""A training-data pipeline over `documents`: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapoint.llm import byte_bpe, mixing, quality, simhash, suffix_dedup
from terrapoint.llm.common import with_row_ids, written
from terrapoint.plans.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judged(docs).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays; of rows that share it, one."""
    rows = with_row_ids(docs, carry=True)
    found = simhash.near_duplicates(rows, id_col="rid", carry=True)
    return found.filter("id = component_id").select("rest.rest.*")


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occurred before go from the texts, with any character that they cut; documents stay."""
    found = suffix_dedup.remove_repeated_strings(docs, carry=True, characters=True)
    text = F.when(F.col("rest.text").isNotNull(), F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it."""
    taken = mixing.mixed(docs).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text; intact: they decode to its bytes."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = byte_bpe.decoded(byte_bpe.encoded(docs.select("doc_id", "lang", "source", "text", digest.alias("digest")), path), path)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("intact"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", string_dedup), ("mixing sources to target weights", mix), ("byte-level BPE", tokenize)]

#: Near-duplicates and the vocabulary are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
