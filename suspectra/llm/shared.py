"""Helpers that several corpus operators share: shared-folder tables and column clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import exists, new_folder, shared_dir, stage_table

__all__ = ["exists", "new_folder", "read_table", "shared_dir", "sized", "spread_join", "stage_table", "text_or_empty"]


def sized(side: DataFrame, rows: int) -> DataFrame:
    """A join's side with a hint: broadcast if it is counted to have at most so many rows, else a shuffled hash join."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side.hint("shuffle_hash")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, parts: int = 8) -> DataFrame:
    """An inner join in which a key's rows of ``big`` are dealt over ``parts`` tasks by a hash of ``by``; ``small`` has few rows a key and is repeated."""
    dealt = big.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return dealt.join(small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "__part"]).drop("__part")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
