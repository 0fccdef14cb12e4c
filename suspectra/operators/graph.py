"""Dependency graph of formulas, vectors (ranges) and cells, as edge tables.

cells: cell_id, worksheet, row, col, raw. A formula is a cell whose text starts
with ``=``; its formula_id is its cell_id. Closures go level by level, each level
aggregated, so that many paths through few nodes stay few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import formula
from ..sources.staging import stage_table

#: Rows of a block of a sheet: ranges meet cells by block.
BLOCK = 1024


@dataclass
class Graph:
    cells: DataFrame
    formulas: DataFrame
    vectors: DataFrame
    f2v: DataFrame
    v2i: DataFrame
    f2i: DataFrame


def scan(cells: DataFrame) -> DataFrame:
    """The table of formulas among the cells."""
    return cells.filter(F.col("raw").rlike("^=")).select(F.col("cell_id").alias("formula_id"), "worksheet", F.col("raw").alias("expr"))


def covered(areas: DataFrame, cells: DataFrame) -> DataFrame:
    """areas (worksheet, top, left, bottom, right and others) with each existing cell (cell_id, row, col) in them.

    A range join by blocks of rows: a range of all rows of a sheet is a thousand rows, however many columns and cells it has.
    """
    at = lambda c: F.floor(c / BLOCK).cast("int")
    blocks = areas.withColumn("block", F.explode(F.sequence(at(F.col("top")), at(F.col("bottom")))))
    placed = cells.select("cell_id", "worksheet", "row", "col").withColumn("block", at(F.col("row")))
    return blocks.join(placed, ["worksheet", "block"]).filter(F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))).drop("block")


def peeled(nodes: DataFrame, needs: DataFrame) -> list[DataFrame]:
    """Tables of node_id, level by level: each needs (node_id, src) lower ones only. Raises if some need each other in a loop."""
    out = []
    left = _peel(nodes, needs, out)
    if left is not None:
        raise ValueError("the formulas have a loop")
    return out


def _peel(nodes: DataFrame, needs: DataFrame, out: list[DataFrame] | None = None) -> DataFrame | None:
    """Takes away nodes without needs, again and again; what is left, if anything: those on loops or behind them."""
    nodes, needs = nodes.select("node_id"), needs.select("node_id", "src")
    while True:
        free = stage_table(nodes.join(needs.select("node_id").distinct(), "node_id", "left_anti"), "level")
        if free.limit(1).count() == 0:
            return nodes if nodes.limit(1).count() else None
        if out is not None:
            out.append(free)
        nodes = stage_table(nodes.join(free, "node_id", "left_anti"), "nodes")
        needs = stage_table(needs.join(free.withColumnRenamed("node_id", "src"), "src", "left_anti").select("node_id", "src"), "needs")


def build(cells: DataFrame) -> Graph:
    formulas = scan(cells)
    found = formula.ranges(formulas)
    corner = ["worksheet", "top", "left", "bottom", "right"]
    # A vector's id is a hash of its corners: no global numbering.
    named = found.withColumn("range_id", F.xxhash64(*corner))
    vectors = named.select("range_id", *corner, (F.col("bottom") - F.col("top") + 1).alias("height"), (F.col("right") - F.col("left") + 1).alias("width")).distinct()
    placed = covered(vectors, cells).withColumn("idx", ((F.col("row") - F.col("top")) * F.col("width") + F.col("col") - F.col("left")).cast("int"))
    v2i = placed.select("range_id", "idx", "cell_id")
    f2i = formula.singles(formulas).join(cells.select("cell_id", "worksheet", "row", "col"), ["worksheet", "row", "col"]).select("formula_id", "cell_id").distinct()
    marked = v2i.join(formulas.select(F.col("formula_id").alias("cell_id"), F.lit(True).alias("f")), "cell_id", "left").groupBy("range_id").agg(F.max(F.col("f").isNull()).alias("perturbable"))
    vectors = vectors.join(marked, "range_id", "left").withColumn("perturbable", F.coalesce("perturbable", F.lit(False)))
    return Graph(cells, formulas, vectors, named.select("formula_id", "range_id").distinct(), v2i, f2i)


def inputs(g: Graph) -> DataFrame:
    """Distinct (formula_id, cell_id): a cell that a formula reads, by itself or in a range."""
    through = g.f2v.join(g.v2i, "range_id").select("formula_id", "cell_id")
    return through.unionAll(g.f2i).distinct()


def reads(g: Graph) -> DataFrame:
    """formula_id, cell_id, times: how often a formula reads a cell, once by itself and once in each of its ranges that holds it."""
    through = g.f2v.join(g.v2i, "range_id").select("formula_id", "cell_id")
    return through.unionAll(g.f2i).groupBy("formula_id", "cell_id").agg(F.count("*").alias("times"))


def describe(g: Graph, cells: DataFrame) -> DataFrame:
    """What the graph knows of some cells (cell_id): raw, is_formula, and the vectors and single cells that a formula reads."""
    asked = cells.select("cell_id").distinct()
    of = lambda edges, what: edges.withColumnRenamed("formula_id", "asked").join(asked.withColumnRenamed("cell_id", "asked"), "asked").groupBy("asked").agg(F.array_sort(F.collect_set(what)).alias(f"reads_{what}"))
    known = asked.join(g.cells, "cell_id").withColumn("is_formula", F.col("raw").rlike("^="))
    for edges, what in ((g.f2v, "range_id"), (g.f2i, "cell_id")):
        known = known.join(of(edges, what), F.col("cell_id") == F.col("asked"), "left").drop("asked")
    return known


def terminal_formulas(g: Graph, all_outputs: bool = False) -> DataFrame:
    """Formulas that no formula reads; or all."""
    if all_outputs:
        return g.formulas.select("formula_id")
    return g.formulas.select("formula_id").join(inputs(g).select(F.col("cell_id").alias("formula_id")), "formula_id", "left_anti")


def terminal_vectors(g: Graph) -> DataFrame:
    return g.vectors.filter("perturbable").select("range_id")


def computation_cells(g: Graph) -> DataFrame:
    return g.v2i.select("cell_id").unionAll(g.f2i.select("cell_id")).distinct()


def _is_formula(g: Graph) -> DataFrame:
    return g.formulas.select(F.col("formula_id").alias("cell_id"))


def leaf_paths(g: Graph) -> DataFrame:
    """formula_id, cell_id, paths: how many paths lead from a formula to a cell that isn't a formula."""
    edges = stage_table(reads(g), "reads")
    inner = edges.join(_is_formula(g), "cell_id", "left_semi").select(F.col("formula_id").alias("node_id"), F.col("cell_id").alias("src"), "times")
    done = edges.join(_is_formula(g), "cell_id", "left_anti").select("formula_id", "cell_id", F.col("times").alias("paths"))
    # From the lowest level up: the paths of a formula are those of its inputs.
    for level in peeled(_is_formula(g).withColumnRenamed("cell_id", "node_id"), inner)[1:]:
        steps = inner.join(level, "node_id", "left_semi").select(F.col("node_id").alias("upper"), F.col("src").alias("formula_id"), "times")
        done = done.unionAll(stage_table(steps.join(done, "formula_id").groupBy(F.col("upper").alias("formula_id"), "cell_id").agg(F.sum(F.col("times") * F.col("paths")).alias("paths")), "paths"))
    return done.groupBy("formula_id", "cell_id").agg(F.sum("paths").alias("paths"))


def leaf_cells(g: Graph) -> DataFrame:
    return leaf_paths(g).select("cell_id").distinct()


def weights(g: Graph) -> DataFrame:
    """cell_id, weight: 1 for a leaf; for a formula the number of paths to leaves."""
    paths = leaf_paths(g)
    return paths.groupBy(F.col("formula_id").alias("cell_id")).agg(F.sum("paths").alias("weight")).unionAll(paths.select("cell_id").distinct().select("cell_id", F.lit(1).cast("long").alias("weight")))


def _formula_needs(g: Graph) -> DataFrame:
    return stage_table(inputs(g).join(_is_formula(g), "cell_id", "left_semi").select(F.col("formula_id").alias("node_id"), F.col("cell_id").alias("src")), "needs")


def formula_closure(g: Graph, needs: DataFrame | None = None) -> DataFrame:
    """Distinct (formula_id, reaches): formulas that a formula depends on, at any depth."""
    steps = stage_table((_formula_needs(g) if needs is None else needs).select(F.col("node_id").alias("formula_id"), F.col("src").alias("reaches")), "closure")
    total, fresh = steps, steps
    while True:
        more = fresh.join(steps.select(F.col("formula_id").alias("reaches"), F.col("reaches").alias("next")), "reaches").select("formula_id", F.col("next").alias("reaches")).distinct()
        fresh = stage_table(more.join(total, ["formula_id", "reaches"], "left_anti"), "closure")
        if fresh.limit(1).count() == 0:
            return total
        total = total.unionAll(fresh)


def _knot(g: Graph) -> DataFrame | None:
    """The needs among formulas on loops, and on the ways between loops; None without any."""
    needs = _formula_needs(g)
    behind = _peel(_is_formula(g).withColumnRenamed("cell_id", "node_id"), needs)
    if behind is None:
        return None
    # Peeled from the other end, too: formulas that none of the rest needs.
    inner = needs.join(behind, "node_id", "left_semi").join(behind.withColumnRenamed("node_id", "src"), "src", "left_semi")
    rest = _peel(behind, inner.select(F.col("src").alias("node_id"), F.col("node_id").alias("src")))
    return inner.join(rest, "node_id", "left_semi").join(rest.withColumnRenamed("node_id", "src"), "src", "left_semi").select("node_id", "src")


def loops(g: Graph) -> DataFrame:
    """formula_id, in_loop: whether a formula depends on itself. The closure is of the knots only."""
    knot = _knot(g)
    if knot is None:
        return g.formulas.select("formula_id", F.lit(False).alias("in_loop"))
    own = formula_closure(g, knot).filter(F.col("formula_id") == F.col("reaches")).select("formula_id", F.lit(True).alias("in_loop"))
    return g.formulas.select("formula_id").join(own, "formula_id", "left").withColumn("in_loop", F.coalesce("in_loop", F.lit(False)))


def contains_loop(g: Graph) -> bool:
    return _peel(_is_formula(g).withColumnRenamed("cell_id", "node_id"), _formula_needs(g)) is not None


def dot(g: Graph) -> DataFrame:
    """The graph's edges as lines of a DOT file, in order of ``line``. Write with ``sources.store.write_dot``."""
    cell = lambda c: F.concat(F.lit("c"), F.col(c))
    vector = F.concat(F.lit("r"), F.hex("range_id"))
    lines = [
        g.f2i.select(F.concat(cell("cell_id"), F.lit(" -> "), cell("formula_id"), F.lit(";")).alias("line")),
        g.f2v.select(F.concat(vector, F.lit(" -> "), cell("formula_id"), F.lit(";")).alias("line")),
        g.f2v.select("range_id").distinct().join(g.v2i, "range_id").select(F.concat(cell("cell_id"), F.lit(" -> "), vector, F.lit(";")).alias("line")),
    ]
    return lines[0].unionAll(lines[1]).unionAll(lines[2]).distinct()
