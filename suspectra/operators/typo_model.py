"""Typing-error model: trained from pairs, as two count tables; errors generated from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import dealt, process_udf
from ..functions.errors import ErrorModel, rng_for
from ..functions.numbers import absolute_error

#: Entries of a model that may go to the driver and executors: characters times strings typed for them, not rows.
MODEL_LIMIT = 1_000_000


def train(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typo: intended, typed, n; transpose: delta, n) from pairs (original, retyped). Equal pairs are aligned once.

    explode would have the planner ask for non-empty arrays below the grouping, and so align every row.
    """
    each = pairs.groupBy("original", "retyped").agg(F.count("*").alias("m")).select("m", process_udf("original", "retyped").alias("p"))
    typo = each.select("m", F.explode_outer("p.typos").alias("t")).filter("t IS NOT NULL").groupBy(F.col("t.intended").alias("intended"), F.col("t.typed").alias("typed")).agg(F.sum("m").alias("n"))
    moves = each.select("m", F.explode_outer("p.deltas").alias("delta")).filter("delta IS NOT NULL").groupBy("delta").agg(F.sum("m").alias("n"))
    return typo, moves


def counts(pairs: DataFrame) -> DataFrame:
    """original, retyped, n_deltas, n_typos of each distinct pair."""
    done = pairs.select("original", "retyped").distinct().withColumn("p", process_udf("original", "retyped"))
    return done.select("original", "retyped", "p.n_deltas", "p.n_typos")


def typo_distribution(typo: DataFrame) -> DataFrame:
    """P(typed | intended); a null intended character is one of its own."""
    return typo.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("intended")))


def transposition_distribution(moves: DataFrame) -> DataFrame:
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def sign_of(raw: str = "raw") -> F.Column:
    """+1, -1 or 0 by the first character of a text."""
    first = F.substring(F.col(raw), 1, 1)
    return F.when(first == "-", -1).when(first == "+", 1).otherwise(0)


def errors(pairs: DataFrame) -> DataFrame:
    """original, retyped and each error of a pair: kind (transposition, typo or sign) with delta, with intended and typed, or with sign."""
    done = pairs.select("original", "retyped").distinct().withColumn("p", process_udf("original", "retyped"))
    null = lambda kind: F.lit(None).cast(kind)
    moves = done.select("original", "retyped", F.explode_outer(F.filter("p.deltas", lambda d: d != 0)).alias("delta")).filter("delta IS NOT NULL").select("original", "retyped", F.lit("transposition").alias("kind"), "delta", null("string").alias("intended"), null("string").alias("typed"), null("int").alias("sign"))
    wrong = done.select("original", "retyped", F.explode_outer(F.filter("p.typos", lambda t: F.coalesce(t["intended"], F.lit("")) != t["typed"])).alias("t")).filter("t IS NOT NULL")
    typos = wrong.select("original", "retyped", F.lit("typo").alias("kind"), null("int").alias("delta"), "t.intended", "t.typed", null("int").alias("sign"))
    turned = done.filter(sign_of("original") != sign_of("retyped"))
    signs = turned.select("original", "retyped", F.lit("sign").alias("kind"), null("int").alias("delta"), null("string").alias("intended"), null("string").alias("typed"), sign_of("retyped").alias("sign"))
    return moves.unionByName(typos).unionByName(signs)


def load(typo: DataFrame, moves: DataFrame) -> ErrorModel:
    """The model in memory; its tables are counted first."""
    if typo.limit(MODEL_LIMIT + 1).count() > MODEL_LIMIT:
        raise ValueError(f"the model has more than {MODEL_LIMIT} entries")
    return ErrorModel({(r["intended"], r["typed"]): r["n"] for r in typo.collect()}, {r["delta"]: r["n"] for r in moves.collect()})


def error_strings(cells: DataFrame, model: ErrorModel, k: int, seed: int = 1, subtle: bool = False) -> DataFrame:
    """cells (cell_id, raw) times k candidates: cell_id, raw, candidate, value."""

    @F.pandas_udf("string")
    def make(cell: pd.Series, candidate: pd.Series, raw: pd.Series) -> pd.Series:
        form = model.subtle_error if subtle else model.error
        return pd.Series([form(r or "", rng_for(seed, c, j)) for c, j, r in zip(cell, candidate, raw, strict=True)])

    each = dealt(cells.select("cell_id", "raw"), "cell_id", "raw").select("cell_id", "raw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("candidate"))
    return each.withColumn("value", make("cell_id", "candidate", "raw"))


def top_of_k(effects: DataFrame) -> DataFrame:
    """effects: cell_id, candidate, value, effect. The candidate with the largest effect of each cell (the first on ties)."""
    best = F.max_by(F.struct("value", "effect"), F.struct("effect", -F.col("candidate")))
    return effects.groupBy("cell_id").agg(best.alias("b")).select("cell_id", "b.value", "b.effect")


def important_errors(effects: DataFrame, share: float = 0.05) -> DataFrame:
    """The top ceil(share * cells) by the largest effect of any candidate."""
    best = top_of_k(effects)
    n = F.count("*").over(Window.partitionBy())
    placed = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("effect").desc(), "cell_id"))).withColumn("n", n)
    return placed.filter(F.col("rank") <= F.ceil(F.lit(share) * F.col("n"))).select("cell_id", "value", "effect")


def effect_on_sum(candidates: DataFrame) -> DataFrame:
    """The change of a sum output by one erroneous input is the change of the input."""
    return candidates.withColumn("effect", absolute_error(F.col("raw"), F.col("value")))
