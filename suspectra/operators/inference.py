"""Hypothesis tests on bootstraps: how unusual an output is without a cell.

The one large shuffle is of (excluded cell, bootstrap) rows, keyed by range, output
and cell; only reachable (range, output) pairs get there. ``analyze_workbook`` goes
from a workbook's cells to scores; ``analyze`` has one formula over each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cut4, number
from ..sources.staging import stage_table
from . import evaluate as workbook
from . import blocks, graph, local
from .bootstrap import draws, evaluate, excluded, resample

SIGNIFICANCE = 0.95
NO_EVIDENCE = 0.5


def are_numeric(boots: DataFrame) -> DataFrame:
    """range_id, output_id, numeric: whether every bootstrap of an output is a number."""
    return boots.groupBy("range_id", "output_id").agg(F.bool_and(number(F.col("value")).isNotNull()).alias("numeric"))


def ranked(boots: DataFrame) -> DataFrame:
    """Bootstraps with their 0-based position in ascending order."""
    return boots.withColumn("pos", F.row_number().over(Window.partitionBy("range_id", "output_id").orderBy("value", "boot_id")) - 1)


def frequencies(boots: DataFrame) -> DataFrame:
    """range_id, output_id, value, share of bootstraps with that value."""
    counts = boots.groupBy("range_id", "output_id", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("range_id", "output_id")))


def outlierness(original: Column, low: Column, high: Column, least: Column, most: Column) -> Column:
    """Distance of the original beyond the band, in units of the tail's length."""
    o, lo, hi, mn, mx = (cut4(c) for c in (original, low, high, least, most))
    above = F.when(mx != hi, F.abs(o - hi) / F.abs(hi - mx)).otherwise(F.abs(o - hi))
    below = F.when(mn != lo, F.abs(o - lo) / F.abs(lo - mn)).otherwise(F.abs(o - lo))
    return F.when(o > hi, above).when(o < lo, below).otherwise(0.0)


def numeric_scores(cells: DataFrame, boots: DataFrame, left_out: DataFrame, originals: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """cell_id, range_id, output_id, outlierness, score.

    cells: range_id, idx, cell_id. boots: range_id, output_id, boot_id, value
    (double). originals: range_id, output_id, original. weight is a column of cells or
    of originals. A cell that no resample leaves out gets NO_EVIDENCE. The values
    without a cell are an array of as many as there are resamples at most.
    """
    low_share = (1 - significance) / 2
    high_share = significance + low_share
    without = left_out.join(boots.select("range_id", "output_id", "boot_id", "value"), ["range_id", "boot_id"])
    ordered = without.groupBy("range_id", "output_id", "idx").agg(F.sort_array(F.collect_list("value")).alias("values")).withColumn("last", F.size("values") - 1)
    at = lambda p: F.get("values", p.cast("int"))
    bands = ordered.select("range_id", "output_id", "idx", at(F.floor(F.col("last") * low_share)).alias("low"), at(F.ceil(F.col("last") * high_share)).alias("high"), F.get("values", F.lit(0)).alias("least"), at(F.col("last")).alias("most"))
    every = cells.join(originals, "range_id")
    tested = every.join(bands, ["range_id", "output_id", "idx"], "left")
    return _scored(tested).select("cell_id", "range_id", "output_id", "outlierness", "score")


def _scored(tested: DataFrame) -> DataFrame:
    """tested (original, weight, low, high, least, most) with outlierness and score."""
    result = F.when(F.col("low").isNull(), F.lit(NO_EVIDENCE)).otherwise(outlierness(F.col("original"), F.col("low"), F.col("high"), F.col("least"), F.col("most")))
    return tested.withColumn("outlierness", result).withColumn("score", F.floor(F.col("weight") * F.col("outlierness")).cast("long"))


def string_scores(cells: DataFrame, boots: DataFrame, left_out: DataFrame, originals: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """cell_id, range_id, output_id, p, score: the weight if the original output is improbable without the cell.

    Without any bootstrap that leaves the cell out, p is 0 and the cell is rejected.
    """
    without = left_out.join(boots, ["range_id", "boot_id"]).join(originals, ["range_id", "output_id"])
    p = without.groupBy("range_id", "output_id", "idx").agg(F.avg(F.when(F.col("value").eqNullSafe(F.col("original")), 1.0).otherwise(0.0)).alias("p"))
    tested = cells.join(originals.drop("original"), "range_id").join(p, ["range_id", "output_id", "idx"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return tested.select("cell_id", "range_id", "output_id", "p", F.when(F.col("p") < 1 - significance, F.col("weight")).otherwise(0).cast("long").alias("score"))


def merge(*scores: DataFrame) -> DataFrame:
    """Sum of scores by cell; truncated before, not after."""
    total = scores[0].select("cell_id", "score")
    for s in scores[1:]:
        total = total.unionAll(s.select("cell_id", "score"))
    return total.groupBy("cell_id").agg(F.sum("score").alias("score"))


def reachable(ranges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Only outputs that depend on a range are tested against it."""
    return ranges.join(outputs, ["range_id"], "left_semi")


def analyze(cells: DataFrame, formula: str = "SUM", boots: int = 200, significance: float = SIGNIFICANCE, seed: int = 1) -> DataFrame:
    """Scores of all cells (range_id, idx, cell_id, v, weight) for one formula over each range. Ranges need two cells or more."""
    return analyze_outputs(cells, {formula: ("v", formula)}, boots, significance, seed).drop("output")


def analyze_outputs(cells: DataFrame, outputs: dict[str, tuple[str, str]], boots: int = 200, significance: float = SIGNIFICANCE, seed: int = 1) -> DataFrame:
    """Scores with ``output``, for several outputs (name: column of cells and formula) of each range: resampled once.

    A range is resampled and tested within a task, so that only its cells are
    shuffled; ranges of more than ``local.DRAWS`` draws are dealt over all tasks.
    """
    if not local.fits(cells, outputs):
        return _dealt_outputs(cells, outputs, boots, significance, seed)
    sizes = cells.groupBy("range_id").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") * boots > local.DRAWS).select("range_id")
    if not large.limit(1).count():
        return _local_outputs(cells, outputs, boots, significance, seed)
    large = stage_table(large, "large")
    small = _local_outputs(cells.join(large, "range_id", "left_anti"), outputs, boots, significance, seed)
    return small.unionByName(_dealt_outputs(cells.join(large, "range_id", "left_semi"), outputs, boots, significance, seed))


def _local_outputs(cells: DataFrame, outputs: dict[str, tuple[str, str]], boots: int, significance: float, seed: int) -> DataFrame:
    low_share = (1 - significance) / 2
    tested = local.tested(cells, outputs, boots, seed, low_share, significance + low_share)
    return _scored(tested.withColumn("output_id", F.col("range_id"))).select("cell_id", "range_id", "output_id", "outlierness", "score", "output")


def _dealt_outputs(cells: DataFrame, outputs: dict[str, tuple[str, str]], boots: int, significance: float, seed: int) -> DataFrame:
    """The same with a row for each draw."""
    sizes = cells.groupBy("range_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 2)
    wide = cells.join(sizes.select("range_id"), "range_id", "left_semi")
    samples = stage_table(resample(wide, boots, seed), "samples")
    once = wide.select("range_id", F.lit(0).alias("boot_id"), "idx", F.lit(1).alias("cnt"))
    left_out = excluded(wide, samples, boots)
    found = None
    for name, (value, formula) in outputs.items():
        output = F.col("range_id").alias("output_id")
        values = evaluate(wide, samples, formula, value).select("range_id", output, "boot_id", F.col("value").cast("double").alias("value"))
        originals = evaluate(wide, once, formula, value).select("range_id", output, F.col("value").cast("double").alias("original"))
        scores = numeric_scores(wide, values, left_out, originals, significance).withColumn("output", F.lit(name))
        found = scores if found is None else found.unionByName(scores)
    return found


def _dense(placed: DataFrame) -> DataFrame:
    """placed with idx counted over the cells that exist: blank places of a range are no inputs."""
    facts = placed.groupBy("range_id").agg(F.count("*").alias("n"), F.max("idx").alias("last"))
    gaps = facts.filter(F.col("n") <= F.col("last")).select("range_id")
    again = placed.join(gaps, "range_id", "left_semi").withColumn("idx", F.row_number().over(Window.partitionBy("range_id").orderBy("idx")) - 1)
    return placed.join(gaps, "range_id", "left_anti").unionByName(again)


def analyze_workbook(cells: DataFrame, boots: int = 2719, significance: float = SIGNIFICANCE, seed: int = 1, weighted: bool = True, all_outputs: bool = False) -> DataFrame:
    """Scores of a workbook's inputs: cell_id, range_id, output_id, numeric, outlierness (numbers), p (texts), score.

    cells: cell_id, worksheet, row, col, raw. Every range with an input is resampled,
    within tasks where ``blocks`` can and else with a row for each draw;
    all formulas downstream of it are evaluated on each resample; each output that
    nothing reads (or all formulas) is tested, as numbers if all its values are
    numbers and else as texts, and weighs as many paths as lead from it to inputs.
    ``merge`` sums the scores by cell.

    An output that doesn't depend on a range gives its cells 0, but for cells that no
    resample leaves out: see ``unreached``.
    """
    cells = stage_table(cells.select("cell_id", "worksheet", "row", "col", "raw"), "cells")
    g = graph.build(cells)
    program = workbook.compiled(g)
    known = stage_table(workbook.present(g, program), "known")
    outputs = graph.terminal_formulas(g, all_outputs).select(F.col("formula_id").alias("output_id"))
    if weighted:
        outputs = outputs.join(graph.weights(g).select(F.col("cell_id").alias("output_id"), "weight"), "output_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    else:
        outputs = outputs.withColumn("weight", F.lit(1).cast("long"))
    outputs = stage_table(outputs.join(known.select(F.col("src").alias("output_id"), F.col("num").alias("num0"), F.col("txt").alias("txt0")), "output_id"), "outputs")
    ranges = g.vectors.filter("perturbable").select("range_id", F.concat_ws(":", "worksheet", "top", "left", "bottom", "right").alias("key"))
    placed = stage_table(_dense(g.v2i).join(ranges, "range_id"), "placed")
    few, readers = blocks.slow(program, known, placed)
    rest, placed = placed.join(few, "range_id", "left_anti"), placed.join(few, "range_id", "left_semi")
    by_blocks = blocks.resampled(rest, known, readers, boots, seed)
    early = by_blocks.filter("src IS NOT NULL").select("range_id", "boot_id", "src", "num", "txt")
    drawn = stage_table(draws(placed, boots, seed, "key").select("range_id", "boot_id", F.col("cell_id").alias("src"), "idx"), "draws")
    values = placed.join(known, F.col("cell_id") == F.col("src")).select("range_id", "idx", "num", "txt")
    changed = stage_table(drawn.join(values, ["range_id", "idx"]).select("range_id", "boot_id", "src", "num", "txt"), "changed")
    made = workbook.scenarios(program, known, changed, boots, early)
    # A range's own formulas may be outputs, too: a resample overwrites them.
    own = changed.join(outputs.select(F.col("output_id").alias("src")), "src", "left_semi").select(*made.columns)
    tested = made.unionByName(own).withColumnRenamed("src", "output_id").join(outputs, "output_id")
    kinds = tested.groupBy("range_id", "output_id", "weight", "num0", "txt0").agg(F.bool_and(F.col("num").isNotNull()).alias("numeric"))
    kinds = stage_table(kinds.withColumn("numeric", F.col("numeric") & F.col("num0").isNotNull()), "kinds")
    results = stage_table(tested.select("range_id", "output_id", "boot_id", "num", "txt").join(kinds.select("range_id", "output_id", "numeric"), ["range_id", "output_id"]), "results")
    left_out = stage_table(excluded(placed, drawn, boots), "left_out")
    slim = placed.select("range_id", "idx", "cell_id")
    numbers = numeric_scores(slim, results.filter("numeric").withColumn("value", F.col("num")), left_out, kinds.filter("numeric").select("range_id", "output_id", "weight", F.col("num0").alias("original")), significance)
    text = workbook.as_text(F.col("num"), F.col("txt"))
    texts = string_scores(slim, results.filter("NOT numeric").withColumn("value", text), left_out, kinds.filter("NOT numeric").select("range_id", "output_id", "weight", workbook.as_text(F.col("num0"), F.col("txt0")).alias("original")), significance)
    columns = ("cell_id", "range_id", "output_id")
    none = F.lit(None).cast("double")
    shape = [*columns, "numeric", "outlierness", "p", "score"]
    low_share = (1 - significance) / 2
    same = text.eqNullSafe(workbook.as_text(F.col("num0"), F.col("txt0"))).alias("same")
    facts = kinds.select("range_id", "output_id", "weight", "numeric", F.col("num0").alias("original"))
    given = results.join(rest.select("range_id").distinct(), "range_id", "left_semi").join(kinds.select("range_id", "output_id", "num0", "txt0"), ["range_id", "output_id"]).select("range_id", "output_id", "numeric", "boot_id", "num", same)
    by_cell = stage_table(blocks.tested(rest, by_blocks, given, boots, low_share, significance + low_share), "tested")
    wide = by_cell.filter("output_id IS NOT NULL").join(F.broadcast(facts), ["range_id", "output_id"])
    known_p = F.coalesce("p", F.lit(0.0))
    lone = rest.select("range_id", "idx", "cell_id").join(by_cell.filter("output_id IS NULL AND NOT evidence").select("cell_id", "range_id"), ["cell_id", "range_id"], "left_semi")
    return (
        numbers.select(*columns, F.lit(True).alias("numeric"), "outlierness", none.alias("p"), "score")
        .unionByName(texts.select(*columns, F.lit(False).alias("numeric"), none.alias("outlierness"), "p", "score"))
        .unionByName(unreached(slim, left_out, kinds, outputs))
        .unionByName(_scored(wide.filter("numeric").withColumn("p", none)).select(*shape))
        .unionByName(wide.filter("NOT numeric").select(*columns, "numeric", none.alias("outlierness"), known_p.alias("p"), F.when(known_p < 1 - significance, F.col("weight")).otherwise(0).cast("long").alias("score")))
        .unionByName(unreached(lone, left_out, kinds, outputs))
    )


def unreached(placed: DataFrame, left_out: DataFrame, kinds: DataFrame, outputs: DataFrame) -> DataFrame:
    """A row (output_id null) for each cell that no resample leaves out: the sum of what outputs count that don't depend on its range.

    Without evidence a number counts half its weight, truncated, and a text its weight.
    """
    alone = F.when(F.col("num0").isNotNull(), F.floor(F.col("weight") * NO_EVIDENCE)).otherwise(F.col("weight")).cast("long")
    every = outputs.agg(F.coalesce(F.sum(alone), F.lit(0)).alias("every"))
    met = kinds.select("range_id", "output_id").join(outputs, "output_id").groupBy("range_id").agg(F.sum(alone).alias("met"))
    lone = placed.join(left_out.select("range_id", "idx").distinct(), ["range_id", "idx"], "left_anti").join(met, "range_id", "left")
    none = F.lit(None)
    return lone.crossJoin(F.broadcast(every)).select("cell_id", "range_id", none.cast("long").alias("output_id"), none.cast("boolean").alias("numeric"), none.cast("double").alias("outlierness"), none.cast("double").alias("p"), (F.col("every") - F.coalesce("met", F.lit(0))).alias("score"))
