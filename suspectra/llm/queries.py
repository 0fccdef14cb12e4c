"""Every query of the corpus operators, by name. Those without SQL are tested against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunks, decontamination, neardup, quality_rules, queries_native, resampling, toxicity
from .shared import read_table


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.sample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "ratio", "weight", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cutoff")


def queries() -> dict:
    return dict(queries_native.QUERIES) | {
        "op3_importance_resampling": op3_importance_resampling,
        "op5_toxicity": op5_toxicity,
        "op6_decontamination": op6_decontamination,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_near_duplicates": op8_near_duplicates,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return queries_native.oracle_sql()
