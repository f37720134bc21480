"""The queries of this subpackage, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from myospark.llm import chat, cotraining, crossentropy, decontamination, importance, infill, linejoin, packing, secrets, sharding, simhash, toxicity, winnowing
from myospark.session import read


def over_documents(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda spark, sf_dir: cotraining.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
        "op2_lm_score": lambda spark, sf_dir: crossentropy.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
        "op3_decontamination": lambda spark, sf_dir: decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
        "op4_line_dedup": over_documents(linejoin.line_report),
        "op5_simhash": over_documents(simhash.simhash_report),
        "op6_sharding": over_documents(sharding.shard_report),
        "op7_toxicity": lambda spark, sf_dir: toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
        "op8_fingerprints": over_documents(winnowing.compare_edits),
        "op9_packing": over_documents(packing.packing_report),
        "op10_secrets": over_documents(secrets.secret_report),
        "op11_importance": lambda spark, sf_dir: importance.importance_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
        "op12_infill": over_documents(infill.infill_report),
        "op13_chat": lambda spark, sf_dir: chat.chat_report(read(spark, sf_dir, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    modules = {"op2_lm_score": crossentropy, "op4_line_dedup": linejoin, "op6_sharding": sharding, "op10_secrets": secrets, "op11_importance": importance, "op12_infill": infill, "op13_chat": chat}
    return {name: module.ORACLE_SQL for name, module in modules.items()}
