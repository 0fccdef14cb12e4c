"""Simulated audit: errors are injected, a detector flags cells one by one, flagged errors are corrected.

A correction changes the data that the next analysis sees, but only in its own range:
``chains`` gets the order of all inspections from as many analyses as a range has
errors at most. Cutoffs that are no regions of scores, cells in several ranges and
numbers that aren't finite go one correction after the other; between two, the order
is fixed, so that a round takes all cells up to the next error at once. Inspected
cells and errors that nobody finds stay in tables. Outputs are sums of ranges. The
audit ends when the detector flags nothing more.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import magnitude_change
from ..sources.staging import stage_table
from ..sources.store import ITERATIONS, RESULT, numbered
from . import chains, evaluate, graph, inference, metrics, normal
from .cutoff import Cutoff

#: The columns of ITERATIONS.
LOGGED = [c.split()[0] for c in ITERATIONS.split(", ")]


@dataclass
class Audit:
    """steps: the inspected cells as rows of ITERATIONS, with k (from 1, their order), cell_id, was_error and the total error behind them."""

    true_positives: list[int] = field(default_factory=list)
    found_at: list[int] = field(default_factory=list)
    effort: int = 0
    n_missed: int = 0
    steps: DataFrame | None = None
    missed: DataFrame | None = None
    seconds: float = 0.0

    @property
    def precision(self) -> float:
        """The sum of the terms of the average precision."""
        return sum((i + 1) / k for i, k in enumerate(self.found_at))

    def _collected(self, *columns: str) -> list[Row]:
        return [] if self.steps is None else self.steps.select("k", *columns).orderBy("k").collect()

    @property
    def false_positives(self) -> list[int]:
        return [r["cell_id"] for r in self._collected("cell_id", "was_error") if not r["was_error"]]

    @property
    def terms(self) -> list[float]:
        at = {k: (i + 1) / k for i, k in enumerate(self.found_at)}
        return [at.get(k, 0.0) for k in range(1, self.effort + 1)]

    @property
    def errors(self) -> list[float]:
        return [r["total"] for r in self._collected("total")]

    @property
    def log(self) -> list[tuple]:
        return [tuple(r)[1:] for r in self._collected(*LOGGED)]


def outputs(cells: DataFrame) -> DataFrame:
    """cell_id (the range's), value (as text): the sum of each range."""
    return cells.groupBy(F.col("range_id").alias("cell_id")).agg(F.sum("v").cast("string").alias("value"))


def prepare(workbook: DataFrame) -> tuple[graph.Graph, DataFrame, DataFrame]:
    """What a simulation on a workbook (cell_id, worksheet, row, col, raw) needs: its graph, the values of all cells, and its outputs.

    A workbook without formulas, without a range of inputs or with a loop is an error.
    """
    g = graph.build(stage_table(workbook.select("cell_id", "worksheet", "row", "col", "raw"), "cells"))
    if g.formulas.limit(1).count() == 0:
        raise ValueError("there is no formula")
    if graph.terminal_vectors(g).limit(1).count() == 0:
        raise ValueError("there is no range with an input")
    # Compiling puts the formulas in order, so it finds loops.
    known = stage_table(evaluate.present(g, evaluate.compiled(g)), "values")
    values = known.select(F.col("src").alias("cell_id"), evaluate.as_text(F.col("num"), F.col("txt")).alias("value"))
    cells = values.join(g.cells.select("cell_id"), "cell_id", "left_semi")
    return g, cells, cells.join(graph.terminal_formulas(g).withColumnRenamed("formula_id", "cell_id"), "cell_id", "left_semi")


def checked(cells: DataFrame) -> DataFrame:
    """The preconditions of a simulation: there are inputs, and ranges of two or more cells."""
    if cells.groupBy("range_id").count().filter("count >= 2").limit(1).count() == 0:
        raise ValueError("there is no range of two or more cells")
    return cells


def _ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ids], "cell_id long")


def inspections(now: DataFrame, known: DataFrame, detector: str, cutoff: Cutoff, boots: int, significance: float) -> DataFrame:
    """cell_id and k (from 1): the cells that the detector would have inspected, in order, if none of them changed."""
    if detector == "bootstrap":
        scores = stage_table(inference.merge(inference.analyze(now, "SUM", boots, significance)), "scores")
        found, order = cutoff.apply(scores, known), [F.col("score").desc(), F.col("cell_id")]
    else:
        by_range = detector == "normal_per_range"
        found = normal.outliers(now, by_range).join(known, "cell_id", "left_anti")
        order = [F.col("range_id"), F.col("rank")] if by_range else [F.col("rank")]
    return found.withColumn("k", F.row_number().over(Window.orderBy(*order))).select("cell_id", "k")


def audit(cells: DataFrame, errors: DataFrame, detector: str = "bootstrap", cutoff: Cutoff = Cutoff("quantile", 0.10), boots: int = 50, significance: float = 0.95, rounds: int | None = None, name: str = "cells") -> Audit:
    """cells: range_id, idx, cell_id, v, weight. errors: cell_id, value (a number). rounds: None, or how many cells the user will inspect.

    The snapshot of outputs is refreshed before an error is measured, so that the
    series shows the state after each correction.
    """
    began = time.time()
    checked(cells)
    correct = stage_table(outputs(cells), "outputs")
    originals = cells.select("cell_id", "range_id", F.col("v").alias("original"))
    pending = stage_table(originals.join(errors.select("cell_id", F.col("value").cast("double").alias("bad")), "cell_id"), "errors")
    budget = min(rounds if rounds is not None else math.inf, cutoff.threshold if cutoff.is_count_based else math.inf)
    settings = (detector, cutoff, boots, significance)
    taken = _chained if chains.applies(cells, pending, detector, cutoff) else _one_by_one
    out, inspected = taken(cells, correct, pending, budget, settings)
    text, level = F.lit, (F.lit(significance), F.lit(float(cutoff.threshold)))
    columns = [text(name), text(detector), *level, F.col("cell_id").cast("string"), "original", "bad", "mean", "size", F.lit(0.0), F.lit(True), "wrong"]
    out.steps = stage_table(inspected.select("k", "cell_id", "total", *[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(columns, LOGGED, strict=True)]), "steps")
    missed = stage_table(pending.join(_ids(cells.sparkSession, out.true_positives), "cell_id", "left_anti"), "missed")
    out.n_missed = missed.count()
    size = magnitude_change(F.col("bad"), F.col("original").cast("double"))
    out.missed = missed.select(text(name), text(detector), *level, F.col("cell_id").cast("string"), F.col("original").cast("string"), F.col("bad").cast("string"), F.lit(float("nan")), size, F.lit(0.0), F.lit(False), F.lit(True))
    out.seconds = time.time() - began
    return out


def _chained(cells: DataFrame, correct: DataFrame, pending: DataFrame, budget: float, settings: tuple) -> tuple[Audit, DataFrame]:
    """An audit by ``chains``, and its inspected cells: k, cell_id, original and bad (texts), size, mean, total, wrong."""
    spark = cells.sparkSession
    given = stage_table(pending.filter("bad IS NOT NULL"), "given")
    known = {r["cell_id"]: (r["range_id"], r["original"], r["bad"]) for r in given.collect()}
    detector, cutoff, boots, significance = settings
    order, by = chains.ordered(cells, given, detector, cutoff, boots, significance)
    placed = numbered(order.select(*dict.fromkeys(["cell_id", "wrong", *by])), by, "k").select("k", "cell_id", "wrong")
    placed = stage_table(placed.filter(F.col("k") <= budget) if budget < math.inf else placed, "order")
    hits = sorted((r["k"], r["cell_id"]) for r in placed.filter("wrong").select("k", "cell_id").collect())
    out = Audit([c for _, c in hits], [k for k, _ in hits], placed.count())
    total, mean = chains.measured(cells, correct, known, out.true_positives)
    at = np.array(out.found_at, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = np.searchsorted(at, b.column(0).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(map(str, b.column(3).to_pylist())), pa.string()), pa.array(total[done]), pa.array(mean[done])], names=["k", "cell_id", "wrong", "original", "total", "mean"])

    every = placed.join(cells.select(F.col("cell_id"), F.col("v").alias("original")), "cell_id").select("k", F.col("cell_id").cast("long"), "wrong", "original")
    every = every.mapInArrow(run, "k int, cell_id long, wrong boolean, original string, total double, mean double")
    of = [(c, str(known[c][2]), _magnitude(known[c][2], known[c][1])) for c in out.true_positives]
    found = spark.createDataFrame(of, "cell_id long, bad string, size double")
    return out, every.join(found, "cell_id", "left").withColumns({"bad": F.coalesce("bad", "original"), "size": F.coalesce("size", F.lit(0.0))})


def _one_by_one(cells: DataFrame, correct: DataFrame, pending: DataFrame, budget: float, settings: tuple) -> tuple[Audit, DataFrame]:
    """The same with an analysis of all cells after each correction."""
    spark = cells.sparkSession
    detector, cutoff, boots, significance = settings
    originals = cells.select("cell_id", F.col("v").alias("original"))
    out, known, log = Audit(), [], []
    now = stage_table(chains.with_errors(cells, pending), "state")
    total, mean = _measured(correct, now)
    while len(known) < budget:
        order = inspections(now, _ids(spark, known), detector, cutoff, boots, significance)
        marked = stage_table(order.join(originals, "cell_id").join(pending.select("cell_id", "bad"), "cell_id", "left"), "order")
        first = marked.agg(F.min(F.when(F.col("bad").isNotNull(), F.col("k")))).first()[0]
        upto = min(first if first is not None else math.inf, budget - len(known))
        taken = sorted((marked.filter(F.col("k") <= upto) if upto < math.inf else marked).collect(), key=lambda r: r["k"])
        found = [r["cell_id"] for r in taken if r["bad"] is not None]
        if found:
            pending = stage_table(pending.join(_ids(spark, found), "cell_id", "left_anti"), "errors")
            now = stage_table(chains.with_errors(cells, pending), "state")
        for r in taken:
            known.append(r["cell_id"])
            wrong = r["bad"] is not None
            if wrong:
                out.true_positives.append(r["cell_id"])
                out.found_at.append(len(known))
                total, mean = _measured(correct, now)
            bad = r["bad"] if wrong else r["original"]
            log.append((len(known), r["cell_id"], total, str(r["original"]), str(bad), mean, _magnitude(bad, r["original"]), wrong))
        if not found:
            break
    out.effort = len(known)
    return out, spark.createDataFrame(log, "k int, cell_id long, total double, original string, bad string, mean double, size double, wrong boolean")


def _measured(correct: DataFrame, now: DataFrame) -> tuple[float, float]:
    """Total and mean error of the outputs, in one job."""
    present = outputs(now)
    row = metrics.total_error(correct, present).crossJoin(F.broadcast(metrics.mean_magnitude(correct, present))).first()
    return float(row["total_error"]), float(row["mean_magnitude"])


def _magnitude(e: float, c: float) -> float:
    return 0.0 if float(e) == float(c) else math.log10(abs(float(e) - float(c)) / abs(float(c) + 1e-12))


def iterations(spark: SparkSession, a: Audit) -> DataFrame:
    """Inspected cells in order, and errors that weren't."""
    inspected = spark.createDataFrame([], ITERATIONS) if a.steps is None else a.steps.orderBy("k").select(*LOGGED)
    return inspected.unionAll(a.missed)


def report(cells: DataFrame, errors: DataFrame, a: Audit, detector: str, significance: float = 0.95, name: str = "cells") -> DataFrame:
    """One row of RESULT."""
    spark = cells.sparkSession
    began = time.time()
    correct = outputs(cells)
    state = lambda left: cells.join(left.select("cell_id", F.col("value").cast("double").alias("bad")), "cell_id", "left").withColumn("v", F.coalesce("bad", F.col("v").cast("double")))
    first, last = outputs(state(errors)), outputs(state(errors.join(_ids(spark, a.true_positives), "cell_id", "left_anti")))
    most = metrics.max_errors(correct, first)
    relative = lambda o: metrics.total_relative_error(metrics.normalized_error(correct, o, most)).first()[0]
    start, end = relative(first), relative(last)
    n = errors.join(cells.select("cell_id"), "cell_id", "left_semi").count()
    inputs = cells.select("cell_id").distinct().count()
    effort = a.effort
    strings = lambda df, c: df.select("cell_id", F.col(c).cast("string").alias("value"))
    sizes = metrics.magnitudes(strings(cells, "v"), strings(errors, "value")).agg(F.max("num_magnitude"), F.max("str_magnitude")).first()
    changed = metrics.magnitudes(correct, first).agg(F.max("num_magnitude"), F.max("str_magnitude")).first()
    row = Row(name, float(start), float(end), float(end / start) if start else 0.0, effort, inputs, effort / max(inputs, 1), n, len(a.true_positives), effort - len(a.true_positives), a.n_missed, float(a.precision / n) if n else 0.0, time.time() - began, a.seconds, detector, significance, True, True, *[float(x) if x is not None else None for x in (*sizes, *changed)])
    return spark.createDataFrame([row], RESULT)


def pick_single_errors(cells: DataFrame, candidates: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """replicate, cell_id, value: one erroneous cell for each replicate, in the order of a hash."""
    order = F.md5(F.concat_ws(":", F.lit(seed), "cell_id"))
    chosen = candidates.filter(F.col("value") != F.col("raw")).orderBy(order, "cell_id", "candidate").limit(replicates)
    return chosen.withColumn("replicate", F.row_number().over(Window.orderBy(order, "cell_id", "candidate"))).select("replicate", "cell_id", "value")
