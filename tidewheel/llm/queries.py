"""One query opN_<name> for each operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from tidewheel.llm import chat, ctw, decontamination, langid, packing, pii, quality, sharding, simhash, toxicity
from tidewheel.llm.common import table
from tidewheel.plans.scratch import root


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", "threshold", "toxic_by_language")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = f"{root(spark)}/slot-maps/{xxh64_hexdigest(sf_dir)}"  # a map for each table, which later runs go on from
    rows, _ = sharding.sharded(table(spark, sf_dir, "documents"), maps=maps)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


#: The conversation that the contract adds.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn int, role string, text string")
    return chat.digests(chat.windows(own.unionByName(added)), in_order=True)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select("doc_id", *(F.col(f"_q_{n}").alias(n) for n in names))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_best_fit_packing, op3_benchmark_decontamination, op4_sharding, op5_chat_formatting,
        op6_lm_scoring, op7_pii, op8_quality_rules, op9_language_id, op10_simhash_near_dedup,
    )
}

SQL: dict[str, str] = {"op8_quality_rules": quality.SQL}
