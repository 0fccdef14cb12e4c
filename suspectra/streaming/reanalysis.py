"""Re-analysis of cells as fixes arrive: each micro-batch of fixes makes a new snapshot and new scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cutoff, inference


def last_fixes(batch: DataFrame) -> DataFrame:
    """cell_id and value of each cell's last fix. Without ``seq`` a cell that is fixed to different values is an error."""
    if "seq" in batch.columns:
        return batch.groupBy("cell_id").agg(F.max_by("v", F.struct("seq", "v")).alias("value"))
    each = batch.groupBy("cell_id").agg(F.min("v").alias("value"), F.max("v").alias("other"))
    return each.select("cell_id", F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(F.raise_error(F.lit("fixes of a cell need seq"))).alias("value"))


def follow_fixes(fixes: DataFrame, cells_path: str, scores_path: str, checkpoint: str, boots: int = 200) -> StreamingQuery:
    """fixes: a stream of (cell_id, v, seq). Of several fixes of a cell in a batch that with the largest ``seq`` (a time or number) wins. Snapshots go to numbered folders under ``cells_path``, scores to ``scores_path``.

    A batch that is repeated after a failure overwrites its own folders.
    """
    spark = fixes.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{cells_path}/{number - 1 if number else 'start'}")
        last = last_fixes(batch)
        cutoff.fix(before, last, "v").write.mode("overwrite").parquet(f"{cells_path}/{number}")
        now = spark.read.parquet(f"{cells_path}/{number}")
        inference.merge(inference.analyze(now, "SUM", boots)).write.mode("overwrite").parquet(f"{scores_path}/{number}")

    return fixes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
