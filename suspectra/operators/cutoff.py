"""Cutoffs: from scores to the list of cells to inspect, and the inspect/fix/mark loop's steps.

scores: cell_id, score. known_good: cell_id. Ranks are taken over regions of tied
scores, one row for each distinct score, never over cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper quantiles of the normal distribution that the normal cutoff knows.
Z = {0.05: 1.6448, 0.1: 1.2815, 0.025: 1.9599, 0.075: 1.4395}


def _unknown(scores: DataFrame, known_good: DataFrame | None) -> DataFrame:
    return scores if known_good is None else scores.join(known_good.select("cell_id"), "cell_id", "left_anti")


def significance_of(text: str) -> float:
    """'5.0' (per cent) -> 0.95; only between 0 and 100, exclusive."""
    percent = float(text)
    if not 0 < percent < 100:
        raise ValueError(f"{text} isn't between 0 and 100 per cent")
    return (100 - percent) / 100


def _regions(scores: DataFrame) -> DataFrame:
    """at (a score), size, n (of all), upto: cells with at least that score."""
    counts = scores.groupBy(F.col("score").alias("at")).agg(F.count("*").alias("size"))
    return counts.withColumn("n", F.sum("size").over(Window.partitionBy())).withColumn("upto", F.sum("size").over(Window.orderBy(F.col("at").desc())))


def above_significance(scores: DataFrame, significance: float, known_good: DataFrame | None = None) -> DataFrame:
    """Cells with a nonzero score of at least that at position N - round(N * s) from the top; ties stay."""
    place = F.least(F.col("n") - F.bround(F.col("n") * significance), F.col("n") - 1)
    level = _regions(scores).filter((place >= F.col("upto") - F.col("size")) & (place < F.col("upto"))).select(F.col("at").alias("level"))
    return _unknown(scores.crossJoin(F.broadcast(level)).filter((F.col("score") >= F.col("level")) & (F.col("score") != 0)).select("cell_id", "score"), known_good)


def flag(candidates: DataFrame) -> DataFrame:
    """The cell to inspect next."""
    return candidates.orderBy(F.col("score").desc(), "cell_id").limit(1)


def mark_ok(known_good: DataFrame, cells: DataFrame) -> DataFrame:
    return known_good.select("cell_id").union(cells.select("cell_id")).distinct()


def reset(known_good: DataFrame) -> DataFrame:
    """No cell is known to be good."""
    return known_good.select("cell_id").filter(F.lit(False))


def fix(cells: DataFrame, fixes: DataFrame, value: str = "raw") -> DataFrame:
    """A new snapshot of the cells with fixed values (cell_id, value)."""
    new = fixes.select("cell_id", F.col("value").alias("__new"))
    return cells.join(new, "cell_id", "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def quantile(scores: DataFrame, share: float, known_good: DataFrame | None = None) -> DataFrame:
    """Whole regions of tied scores from the top, as long as they start below the share and end within it."""
    inside = (F.col("upto") / F.col("n") < share + 1.0 / F.col("n")) & ((F.col("upto") - F.col("size")) / F.col("n") < share)
    taken = _regions(scores).filter(inside).select("at")
    return _unknown(scores.join(taken, F.col("score") == F.col("at"), "left_semi").select("cell_id", "score"), known_good)


def quantile_compat(ordered: list[tuple[int, int]], share: float) -> list[tuple[int, int]]:
    """The literal walk over (cell, score) pairs, in descending order: the first member of each later region is passed over."""
    n, out = len(ordered), []
    start = end = 0
    while start < n and start / n < share:
        end += next((k for k, (_, v) in enumerate(ordered[end:]) if v != ordered[start][1]), n - end)
        if end / n >= share + 1 / n:
            break
        out += ordered[start:end]
        start = max(start, end) + 1
    return out


def quantile_walk(scores: DataFrame, share: float) -> DataFrame:
    """What ``quantile_compat`` selects, from the regions of tied scores.

    After the first region, a region loses its first member; behind one that has no other, the walk finds nothing more.
    """
    order = Window.orderBy(F.col("score").desc())
    regions = scores.groupBy("score").agg(F.count("*").alias("size"), F.min("cell_id").alias("head")).withColumn("n", F.sum("size").over(Window.partitionBy()))
    placed = regions.withColumn("upto", F.sum("size").over(order)).withColumn("later", (F.row_number().over(order) > 1).cast("int"))
    start = F.col("upto") - F.col("size") + F.col("later")
    lone = F.max(F.when((F.col("later") == 1) & (F.col("size") == 1), 1).otherwise(0)).over(order)
    inside = (start < F.col("n")) & (start / F.col("n") < share) & (F.col("upto") / F.col("n") < share + 1.0 / F.col("n"))
    taken = placed.withColumn("lone", lone).filter(inside & (F.col("lone") == 0)).select(F.col("score").alias("__score"), "head", "later")
    return scores.join(taken, (F.col("score") == F.col("__score")) & ((F.col("later") == 0) | (F.col("cell_id") != F.col("head"))), "left_semi").select("cell_id", "score")


def number(scores: DataFrame, n: int, known_good: DataFrame | None = None) -> DataFrame:
    """The first n, less the known good ones among them."""
    return _unknown(scores.orderBy(F.col("score").desc(), "cell_id").limit(n).select("cell_id", "score"), known_good)


def normal(scores: DataFrame, share: float) -> DataFrame:
    """Scores above mean + z standard deviations of the population."""
    if share not in Z:
        raise ValueError(f"no quantile for {share}; known: {sorted(Z)}")
    facts = scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    return scores.crossJoin(F.broadcast(facts)).filter(F.col("score") > F.col("mean") + Z[share] * F.col("sd")).select("cell_id", "score")


@dataclass(frozen=True)
class Cutoff:
    """kind: significance, quantile, number or normal."""

    kind: str
    threshold: float

    @property
    def is_count_based(self) -> bool:
        return self.kind == "number"

    def apply(self, scores: DataFrame, known_good: DataFrame | None = None) -> DataFrame:
        if self.kind == "number":
            return number(scores, math.floor(self.threshold), known_good)
        if self.kind == "normal":
            return normal(scores, self.threshold)
        return {"significance": above_significance, "quantile": quantile}[self.kind](scores, self.threshold, known_good)
