"""Error metrics between correct and incorrect values. Values are strings; numbers are a matter of parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import absolute_error, both_numbers, categorical_change, magnitude_change, number


def _pairs(correct: DataFrame, incorrect: DataFrame) -> DataFrame:
    """cell_id, correct, incorrect. Both inputs: cell_id, value."""
    return correct.select("cell_id", F.col("value").alias("correct")).join(incorrect.select("cell_id", F.col("value").alias("incorrect")), "cell_id")


def inject(cells: DataFrame, errors: DataFrame) -> DataFrame:
    """cells (cell_id, raw, is_formula) with erroneous values (cell_id, value); formulas keep theirs."""
    new = errors.select("cell_id", F.col("value").alias("__new"))
    value = F.when(~F.col("is_formula") & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("raw"))
    return cells.join(new, "cell_id", "left").withColumn("raw", value).drop("__new")


def max_errors(correct: DataFrame, incorrect: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """cell_id, err: the largest error seen so far of each output."""
    now = _pairs(correct, incorrect).select("cell_id", absolute_error(F.col("correct"), F.col("incorrect")).alias("err"))
    if previous is not None:
        now = now.unionAll(previous.select("cell_id", "err"))
    return now.groupBy("cell_id").agg(F.max("err").alias("err"))


def total_error(correct: DataFrame, incorrect: DataFrame) -> DataFrame:
    return _pairs(correct, incorrect).agg(F.coalesce(F.sum(absolute_error(F.col("correct"), F.col("incorrect"))), F.lit(0.0)).alias("total_error"))


def normalized_error(correct: DataFrame, incorrect: DataFrame, largest: DataFrame) -> DataFrame:
    """cell_id, err: numeric differences in units of the output's largest error (0 if that is 0), else 0 or 1."""
    both = _pairs(correct, incorrect).join(largest.select("cell_id", F.col("err").alias("most")), "cell_id")
    numeric = F.when(F.col("most") == 0, F.lit(0.0)).otherwise(F.abs(number(F.col("incorrect")) - number(F.col("correct"))) / F.col("most"))
    return both.select("cell_id", F.when(both_numbers(F.col("correct"), F.col("incorrect")), numeric).otherwise(categorical_change(F.col("incorrect"), F.col("correct"))).alias("err"))


def total_relative_error(normalized: DataFrame) -> DataFrame:
    return normalized.agg(F.coalesce(F.avg("err"), F.lit(0.0)).alias("total_relative_error"))


def magnitudes(originals: DataFrame, errors: DataFrame) -> DataFrame:
    """cell_id, num_magnitude, str_magnitude of each erroneous input."""
    both = _pairs(originals, errors)
    numeric = both_numbers(F.col("correct"), F.col("incorrect"))
    return both.select("cell_id", F.when(numeric, magnitude_change(number(F.col("incorrect")), number(F.col("correct")))).otherwise(0.0).alias("num_magnitude"), F.when(numeric, 0.0).otherwise(categorical_change(F.col("incorrect"), F.col("correct"))).alias("str_magnitude"))


def mean_magnitude(correct: DataFrame, incorrect: DataFrame) -> DataFrame:
    """Mean of |e - c| / |c|. Blanks count as 0, other text is skipped, and so is a correct value of 0; without rows: 0."""
    blank = lambda c: number(F.when(F.trim(c) == "", F.lit("0")).otherwise(c))
    both = _pairs(correct, incorrect).select(blank(F.col("correct")).alias("c"), blank(F.col("incorrect")).alias("e"))
    return both.agg(F.coalesce(F.avg(F.when(F.col("c") != 0, F.abs(F.col("e") - F.col("c")) / F.abs(F.col("c")))), F.lit(0.0)).alias("mean_magnitude"))


def false_negatives(errors: DataFrame, true_positives: DataFrame, false_positives: DataFrame) -> DataFrame:
    seen = true_positives.select("cell_id").unionAll(false_positives.select("cell_id"))
    return errors.select("cell_id").join(seen, "cell_id", "left_anti")


def precision_terms(inspected: DataFrame) -> DataFrame:
    """inspected: k (1-based order), cell_id, is_error. Adds the term P(k) * rel(k)."""
    found = F.sum(F.col("is_error").cast("int")).over(Window.orderBy("k"))
    return inspected.withColumn("term", F.when(F.col("is_error"), found / F.col("k")).otherwise(0.0))


def average_precision(inspected: DataFrame, errors: DataFrame) -> DataFrame:
    n = errors.agg(F.count("*").alias("n"))
    return precision_terms(inspected).agg(F.sum("term").alias("s")).crossJoin(F.broadcast(n)).select(F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("average_precision"))
