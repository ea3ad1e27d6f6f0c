"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm import language_id, sql, toxicity
from lacuna.llm.byte_bpe import encode_and_decode
from lacuna.llm.conversation_repair import repair
from lacuna.llm.fingerprints import fingerprint
from lacuna.llm.near_dedup import near_duplicates
from lacuna.llm.packing import pack
from lacuna.llm.prefix_trie import prefix_trie, turn_lists
from lacuna.llm.projection_forest import nearest
from lacuna.llm.quality_rules import compression_bands
from lacuna.llm.sharding import shard_documents
from lacuna.llm.suffix_dedup import repeated_spans
from lacuna.llm.token_attribution import count_tokens

#: Characters of a section in the token counts.
SECTION = 1000

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    at = F.sequence(F.lit(0), F.greatest(F.length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)), F.lit(SECTION))
    docs = docs.withColumn("sections", F.transform(at, lambda x: F.struct(x.alias("start"), (x + SECTION).alias("end"))))
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="majority", sections_col="sections")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), n_shards=16)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.remainder("doc_id", 3) == 1
    return language_id.predict(docs, language_id.train(docs, ~held_out), held_out)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = language_id.remainder("doc_id", 5) == 0
    return toxicity.score(docs, toxicity.train(docs, labels, ~held_out), held_out)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a hash of conversation and turn deals out; `copies` is 0 for a dropped row and 2 for a repeated one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    broken = F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(text("role")).alias("role"), broken.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def rebuilt(turns: DataFrame, group: int = 20) -> DataFrame:
    """(conv_id, turns): each conversation with its first turns, up to three by a hash of its id, from the first of its group."""
    first = F.max(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, 3))).over(Window.partitionBy("near"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    own = F.slice("turns", taken + 1, F.size("turns"))
    none = F.slice("turns", 1, 0)
    return turns.withColumn("head", first).select("conv_id", F.concat(F.coalesce(F.slice("head", 1, taken), none), own).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_lists(conversations(spark, sf_dir), near=20)))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(conversations(spark, sf_dir)), copies=F.col("copies"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": sql.PREFIX_TRIE, "op13_conversation_repair": sql.CONVERSATION_REPAIR}
