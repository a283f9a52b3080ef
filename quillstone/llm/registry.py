"""Queries and oracle SQL of this subpackage; ``__spark_entry__`` adds them if it can import this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.classifier import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.chat import format_chats, read_back

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(conv.unionByName(more)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.conversation_repair import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_substring_dedup, op4_quality_classifier, op5_near_dedup, op6_license_scan, op7_packing, op8_chat_format, op9_decontaminate, op10_lm_scores, op11_conversation_repair, op12_resampling, op13_toxicity, pipeline)}


def oracle_sql() -> dict[str, str]:
    from quillstone.llm import conversation_repair, licenses, resampling

    return {"op6_license_scan": licenses.oracle(), "op11_conversation_repair": conversation_repair.oracle(), "op12_resampling": resampling.oracle()}
