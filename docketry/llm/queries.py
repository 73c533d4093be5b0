"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import automaton, exact_dedup, kneser_ney, mixing, ngram_join, packing, passages, pii, quality_rules, secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": _on_documents(secrets.op1_secret_scans),
        "op2_mixing": _on_documents(mixing.op2_mixing),
        "op3_lm_scoring": _on_documents(automaton.op3_lm_scoring),
        "op4_quality_classifier": lambda spark, sf_dir: kneser_ney.op4_quality_classifier(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        "op5_best_fit_packing": _on_documents(packing.op5_best_fit_packing),
        "op6_substring_dedup": _on_documents(passages.op6_substring_dedup),
        "op7_pii": _on_documents(pii.op7_pii),
        "op8_quality_rules": _on_documents(quality_rules.op8_quality_rules),
        "op9_ngram_jaccard": _on_documents(ngram_join.op9_ngram_jaccard),
        "op10_exact_dedup": _on_documents(exact_dedup.op10_exact_dedup),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": secrets.OP1_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
    }
