"""The cleaning pipeline over `documents`: each stage reads what the one before kept.

Language ID and toxicity drop the documents they reject, near-dedup all but one
of each group, suffix-array dedup the bytes that a smaller document has; packing
cuts the rest into sequences.  All but the last return the columns they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import language_id, near_dedup, packing, suffix_dedup, toxicity
from lacuna.sources.tables import cut_lineage

#: Scores below this are no better than a guess among four languages or more.
LEAST_LANGUAGE_SCORE = 0.35
#: No SQL can state the learned stages; tests hold the pipeline against its operators and brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.remainder("doc_id", 3) != 1, least_score=LEAST_LANGUAGE_SCORE)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, labels, language_id.remainder("doc_id", 5) != 0)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("language_id", language), ("toxicity", civil), ("near_dedup", near_unique), ("suffix_dedup", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written as Parquet and read again, and removed when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
