"""A training-data pipeline over the documents table: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; the last returns the mix. Extra columns of documents are carried along.
Empty tables pass through; how each operator treats nulls, ties and repeats is in
its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suspectra.llm import decontamination, mixing, neardup, resampling, secrets
from suspectra.llm.shared import read_table, sized, stage_table

#: Ids, of a few bytes each, up to which they are broadcast; beyond, texts are shuffled to them.
FEW_IDS = 1_000_000
#: No SQL: stages learn models and compare sketches. They are tested against plain versions.
ORACLE_SQL = None


def _keep(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs' rows whose id is (left_semi) or isn't (left_anti) among ``ids``; counted ids are broadcast while they are few."""
    one = stage_table(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(), "ids")
    return docs.join(sized(one, FEW_IDS), docs["doc_id"].eqNullSafe(one["__id"]), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents outside the importance sample go."""
    judged = resampling.sample(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    # Rows of one id stay if any of them does; rejected ids are the few.
    bad = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter(~F.col("kept"))
    return _keep(docs, bad, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near duplicates stays, the one with the smallest id.

    Rows without an id, or with one that other rows have, get an id from a hash of id
    and text, beyond all ids: rows that are equal are one document, others are not.
    Without words a row is linked with nothing and keeps its own.
    """
    often = stage_table(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__often")), "often")
    seen = docs.join(sized(often, FEW_IDS), F.col("doc_id") == F.col("__often"), "left")
    odd = (F.col("doc_id").isNull() | F.col("__often").isNotNull()) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    far = 1 << 62
    keyed = seen.withColumn("__odd", odd).withColumn("__key", F.when(odd, F.lit(far) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(far))).otherwise(F.col("doc_id"))).drop("__often")
    judged = neardup.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5)
    gone = stage_table(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    left = keyed.join(sized(gone, FEW_IDS), F.col("__key").eqNullSafe(F.col("__gone")), "left_anti")
    # Only the odd rows, if any, are compared for repeats.
    return left.filter(~F.col("__odd")).select(*docs.columns).unionAll(left.filter("__odd").dropDuplicates(["__key"]).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a passage like a benchmark item go."""
    leaks = decontamination.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return _keep(docs, leaks.select("doc_id"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are cut out of the texts; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: how many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
