"""Normal-distribution baselines: cells more than two standard deviations off their range's mean.

cells: range_id, cell_id, v (double; null if not numeric).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: standard deviations from the mean.
LIMIT = 2.0


def summary(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("v").isNotNull()).groupBy("range_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("sd"))


def outliers(cells: DataFrame, per_range: bool = True) -> DataFrame:
    """range_id, cell_id, v, z, rank (1: farthest), by range or over the union of all ranges.

    The statistics are aggregated and joined: a range with most of the rows is spread
    over all tasks, and only outliers are ranked.
    """
    known = cells.filter(F.col("v").isNotNull())
    keys = ["range_id"] if per_range else []
    facts = known.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    joined = known.join(facts, "range_id") if per_range else known.crossJoin(F.broadcast(facts))
    far = joined.withColumn("z", F.when(F.col("sd") > 0, F.abs(F.col("v") - F.col("mean")) / F.col("sd"))).filter(F.col("z") > LIMIT)
    return far.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("z").desc(), "cell_id"))).select("range_id", "cell_id", "v", "z", "rank")


def step_per_range(cells: DataFrame, known_good: DataFrame) -> DataFrame:
    """The next cell: of the first range that has an outlier not yet inspected, the farthest."""
    return outliers(cells).join(known_good.select("cell_id"), "cell_id", "left_anti").orderBy("range_id", "rank").limit(1).select("cell_id", "range_id", "z")


def step_all(cells: DataFrame, known_good: DataFrame) -> DataFrame:
    return outliers(cells, False).join(known_good.select("cell_id"), "cell_id", "left_anti").orderBy("rank").limit(1).select("cell_id", "range_id", "z")
