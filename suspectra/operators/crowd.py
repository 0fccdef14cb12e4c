"""Crowd-sourced retyping: accuracy of workers and items. retyped: worker_id, item columns, original, retyped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, the layout of a crowd row: where the worker, the items and their fields are.
WORKER_AT, ITEMS_AT, FIELDS = 15, 28, ("path", "workbook", "worksheet", "row", "col", "original", "image_url")


def items_per_row(width: int) -> int:
    """Items in a row of so many columns: each has its fields and, at the end, an answer."""
    return (width - ITEMS_AT) // (len(FIELDS) + 1)


def unpivot(rows: DataFrame) -> DataFrame:
    """One row per retyped item from wide rows (columns by position)."""
    names, n = rows.columns, items_per_row(len(rows.columns))
    answers_at = ITEMS_AT + n * len(FIELDS)
    at = lambda k: F.col(f"`{names[k]}`")
    cells = [F.struct(*[at(ITEMS_AT + i * len(FIELDS) + k).cast("string").alias(f) for k, f in enumerate(FIELDS)], at(answers_at + i).cast("string").alias("retyped")) for i in range(n)]
    flat = rows.select(at(WORKER_AT).cast("string").alias("worker_id"), F.explode(F.array(*cells)).alias("x")).select("worker_id", "x.*").drop("image_url")
    return flat.withColumn("row", F.col("row").try_cast("int")).withColumn("col", F.col("col").try_cast("int"))


def _right():
    return F.when(F.col("original").eqNullSafe(F.col("retyped")), 1.0).otherwise(0.0)


def accuracy(retyped: DataFrame) -> DataFrame:
    return retyped.agg(F.avg(_right()).alias("accuracy"), F.count("*").alias("n_inputs"), F.count_distinct("worker_id").alias("n_workers"))


def by_worker(retyped: DataFrame) -> DataFrame:
    return retyped.groupBy("worker_id").agg(F.count("*").alias("assignments"), F.avg(_right()).alias("accuracy"))


def busiest(retyped: DataFrame) -> DataFrame:
    return by_worker(retyped).orderBy(F.col("assignments").desc(), "worker_id").limit(1).select("worker_id", "assignments")


def by_accuracy(retyped: DataFrame) -> DataFrame:
    return by_worker(retyped).orderBy(F.col("accuracy").desc(), "worker_id")


def pairs(retyped: DataFrame) -> DataFrame:
    return retyped.select("original", "retyped")


def char_error_rate(retyped: DataFrame) -> DataFrame:
    """1 - characters typed right over characters, by position."""
    o, r = F.col("original"), F.col("retyped")
    longest = F.greatest(F.char_length(o), F.char_length(r))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.char_length(o), F.char_length(r)), F.lit(1))), lambda k: (F.substring(o, k, F.lit(1)) != "") & (F.substring(o, k, F.lit(1)) == F.substring(r, k, F.lit(1)))))
    sums = retyped.agg(F.sum(same).alias("same"), F.sum(longest).alias("n"))
    return sums.select(F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(1 - F.col("same") / F.col("n")).alias("char_error_rate"))
