"""Bootstrap resampling of ranges of cells, as rows.

cells: range_id, idx (0-based position in its range), cell_id and a value. A
resample is a histogram of positions; a position without a row is excluded. Nothing
is written back to the cells. Sums, counts and averages come from the histogram
(count times value); medians weigh values by their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import draw

SEED = 1
#: Positions of a range that are looked at together.
BLOCK = 4096


def slots(cells: DataFrame) -> DataFrame:
    """range_id, slot, n and others of the cells, dealt over all tasks: each row will become as many as there are resamples."""
    sizes = cells.groupBy("range_id").agg(F.count("*").alias("n"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.withColumnRenamed("idx", "slot").join(sizes, "range_id").repartition(parts, "range_id", "slot")


def draws(cells: DataFrame, boots: int, seed: int = SEED, key: str = "range_id") -> DataFrame:
    """``slots`` with boot_id and idx, the position that a slot's draw takes. key: the column that tells ranges apart in the hash."""
    each = slots(cells).withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
    return each.withColumn("idx", draw(seed, F.col(key), F.col("boot_id"), F.col("slot"), F.col("n")).cast("int"))


def resample(cells: DataFrame, boots: int, seed: int = SEED) -> DataFrame:
    """range_id, boot_id, idx, cnt: n draws with replacement from each range of n cells, ``boots`` times."""
    return draws(cells.select("range_id", "idx"), boots, seed).groupBy("range_id", "boot_id", "idx").agg(F.count("*").cast("int").alias("cnt"))


def excluded(cells: DataFrame, samples: DataFrame, boots: int) -> DataFrame:
    """range_id, idx, boot_id of positions that a resample leaves out.

    What a block of positions leaves out is its complement, so that only the drawn
    positions are shuffled; an array has at most BLOCK of them.
    """
    sizes = cells.groupBy("range_id").agg(F.count("*").cast("int").alias("n"))
    grid = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int")))).withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
    drawn = samples.groupBy("range_id", "boot_id", F.floor(F.col("idx") / BLOCK).cast("int").alias("block")).agg(F.collect_set(F.col("idx").cast("int")).alias("drawn"))
    every = F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1)
    rest = F.array_except(every, F.coalesce("drawn", F.array().cast("array<int>")))
    return grid.join(drawn, ["range_id", "boot_id", "block"], "left").select("range_id", F.explode(rest).alias("idx"), "boot_id")


def included(samples: DataFrame, size: Column | None = None) -> DataFrame:
    """Include counts of a resample as text, by position."""
    return samples.groupBy("range_id", "boot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "cnt"))), lambda x: F.concat_ws("x", x["idx"], x["cnt"])), " ").alias("histogram"))


#: Formula name -> aggregate of a value and its count in the resample.
AGGREGATES = {
    "SUM": lambda v, c: F.sum(v * c),
    "COUNT": lambda v, c: F.sum(F.when(v.isNotNull(), c)),
    "AVERAGE": lambda v, c: F.sum(v * c) / F.sum(F.when(v.isNotNull(), c)),
    "MEDIAN": lambda v, c: F.percentile(v, F.lit(0.5), c),
    "MIN": lambda v, c: F.min(v),
    "MAX": lambda v, c: F.max(v),
}


def evaluate(cells: DataFrame, samples: DataFrame, formula: str, value: str = "v") -> DataFrame:
    """range_id, boot_id, value of a formula over each resample."""
    joined = samples.join(cells.select("range_id", "idx", F.col(value).alias("__v")), ["range_id", "idx"])
    return joined.groupBy("range_id", "boot_id").agg(AGGREGATES[formula](F.col("__v"), F.col("cnt")).alias("value"))


def distinct_histograms(samples: DataFrame) -> DataFrame:
    """The first resample of each distinct histogram of a range: what a memo would evaluate."""
    return included(samples).groupBy("range_id", "histogram").agg(F.min("boot_id").alias("boot_id"), F.count("*").alias("n_equal"))
