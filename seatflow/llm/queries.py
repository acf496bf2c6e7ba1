"""One registered query per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.llm import (chat, exact_dedup, filter_audit, mixing, near_dedup, oracles, packing, pii,
                          quality_classifier, quality_rules, source_divergence, token_counts, token_output, toxicity)
from seatflow.llm.common import read
from seatflow.session import apply_runtime_conf


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(apply_runtime_conf(spark), sf_dir, "documents")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_report(_documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, whose texts are control strings."""
    turns = read(apply_runtime_conf(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.chat_report(turns.unionByName(extra))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op4_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_documents(spark, sf_dir))


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(apply_runtime_conf(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_shards, op2_chat_format, op3_mix_sources, op4_near_classes, op5_pack_documents,
             op6_exact_dedup, op7_toxicity, op8_pii_pseudonyms, op9_quality_rules, op10_quality_classifier, op11_token_counts,
             op12_filter_audit, op13_source_divergence, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": oracles.CHAT, "op3_mix_sources": oracles.MIX, "op6_exact_dedup": oracles.EXACT,
            "op12_filter_audit": oracles.AUDIT, "op13_source_divergence": oracles.DIVERGENCE}
