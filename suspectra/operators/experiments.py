"""Experiments: which errors a detector finds. Each returns rows of RESULT, a detector and a replicate after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import ErrorModel
from ..functions.numbers import number
from . import simulate, typo_model
from .cutoff import Cutoff

DETECTORS = (("bootstrap", Cutoff("quantile", 0.10)), ("normal_all", Cutoff("quantile", 0.10)))


def run(cells: DataFrame, errors: DataFrame, boots: int = 2700, significance: float = 0.95, rounds: int | None = None, name: str = "cells", detectors=DETECTORS) -> DataFrame:
    """The detectors in turn on the same errors (cell_id, value)."""
    found = None
    for detector, cutoff in detectors:
        done = simulate.audit(cells, errors, detector, cutoff, boots, significance, rounds, name)
        row = simulate.report(cells, errors, done, detector, significance, name)
        found = row if found is None else found.unionAll(row)
    return found


def candidates(cells: DataFrame, model: ErrorModel, k: int, subtle: bool = False, seed: int = 1) -> DataFrame:
    """Numeric candidates of each cell: cell_id, raw, candidate, value. Generated text that isn't a number has no place in a sum."""
    raw = cells.select("cell_id", F.col("v").cast("string").alias("raw"))
    made = typo_model.error_strings(raw, model, k, seed, subtle)
    return made.filter(number(F.col("value")).isNotNull())


def important(cells: DataFrame, model: ErrorModel, k: int = 5, share: float = 0.05, **options) -> DataFrame:
    """The most harmful of k errors in each input, in the share of inputs where they do most harm."""
    errors = typo_model.important_errors(typo_model.effect_on_sum(candidates(cells, model, k)), share).filter("effect > 0")
    return run(cells, errors.select("cell_id", F.col("value").cast("double").alias("value")), **options)


def _replicates(cells: DataFrame, made: DataFrame, replicates: int, options: dict) -> DataFrame:
    chosen = simulate.pick_single_errors(cells, made, replicates).collect()
    spark, found = cells.sparkSession, None
    for r in chosen:
        rows = run(cells, spark.createDataFrame([(r["cell_id"], float(r["value"]))], "cell_id long, value double"), **options).withColumn("replicate", F.lit(r["replicate"]))
        found = rows if found is None else found.unionAll(rows)
    return found


def proportion(cells: DataFrame, model: ErrorModel, replicates: int = 100, **options) -> DataFrame:
    """Single random errors, each in a run of its own."""
    return _replicates(cells, candidates(cells, model, 1), replicates, options)


def subtlety(cells: DataFrame, model: ErrorModel, replicates: int = 100, **options) -> DataFrame:
    """Single errors whose relative size is below 1."""
    return _replicates(cells, candidates(cells, model, 1, subtle=True), replicates, options)
