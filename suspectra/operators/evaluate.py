"""Evaluation of a workbook's formulas: its present values, and scenarios in which ranges hold resampled values.

Formulas are compiled to nodes (aggregates and calculations) and evaluated level by
level: a level's nodes need lower ones only. Aggregates are grouped in the JVM;
calculations run in Arrow batches. A scenario evaluates only nodes downstream of its
range; other members keep their present values.

Values are a pair: ``num`` for numbers, ``txt`` for texts and errors, both null for
blanks. A reference to a cell that doesn't exist is a blank.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expression
from ..functions.numbers import number
from ..sources.staging import stage_table
from . import graph

PARSED = "formula_id long, seq int, last boolean, func string, program string, arg int, kind string, worksheet string, top int, left int, bottom int, right int, child int, num double"
VALUE = T.StructType().add("num", T.DoubleType()).add("txt", T.StringType())


@dataclass
class Program:
    """levels: the nodes of each level (node_id, func, program); members: node_id, arg, src (a cell or node), num (of a constant)."""

    levels: list[DataFrame]
    members: DataFrame
    funcs: list[str]


def typed(raw: Column) -> tuple[Column, Column]:
    """(num, txt) of a cell's text."""
    num = number(raw)
    return num, F.when(num.isNull() & (F.trim(raw) != ""), raw)


def as_text(num: Column, txt: Column) -> Column:
    """A value as text: whole numbers without a point, others with up to ten decimals."""
    size = F.abs(num)
    plain = F.regexp_replace(num.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    whole = num.cast("decimal(20,0)").cast("string")
    shown = F.when((num == F.floor(num)) & (size < 1e15), whole).when((size >= 1e-4) & (size < 1e15), plain).otherwise(num.cast("string"))
    return F.when(num.isNotNull(), shown).otherwise(F.coalesce(txt, F.lit("")))


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for frame in frames:
        rows = []
        for formula, sheet, text in zip(frame["formula_id"], frame["worksheet"], frame["expr"], strict=True):
            nodes = expression.parse(text, sheet or "")
            for seq, node in enumerate(nodes):
                head = (formula, seq, seq == len(nodes) - 1, node.func, json.dumps(node.program) if node.func == "CALC" else None)
                for arg, (kind, what) in enumerate(node.members):
                    where = what if kind in ("cell", "range") else (None,) * 5
                    rows.append((*head, arg, kind, *where, what if kind == "node" else None, float(what) if kind == "const" else None))
                if not node.members:
                    rows.append((*head, *(None,) * 9))
        out = pd.DataFrame(rows, columns=names)
        ints = ("arg", "top", "left", "bottom", "right", "child")
        yield out.astype({c: "Int32" for c in ints})


def compiled(g: graph.Graph) -> Program:
    """The graph's formulas as nodes by level. Formulas in a loop are an error."""
    parsed = stage_table(g.formulas.mapInPandas(_parse, PARSED), "parsed")
    node_of = lambda seq: F.xxhash64("formula_id", seq)
    each = parsed.withColumn("node_id", F.when(F.col("last"), F.col("formula_id")).otherwise(node_of(F.col("seq"))))
    own = ["node_id", "arg"]
    cells = g.cells.select("cell_id", "worksheet", "row", "col")
    areas = each.filter(F.col("kind").isin("cell", "range")).select(*own, "worksheet", "top", "left", "bottom", "right")
    lone = areas.filter((F.col("top") == F.col("bottom")) & (F.col("left") == F.col("right"))).withColumnsRenamed({"top": "row", "left": "col"}).join(cells, ["worksheet", "row", "col"])
    wide = graph.covered(areas.filter((F.col("top") != F.col("bottom")) | (F.col("left") != F.col("right"))), cells)
    none = F.lit(None).cast("double").alias("num")
    members = (
        lone.select(*own, F.col("cell_id").alias("src"), none)
        .unionByName(wide.select(*own, F.col("cell_id").alias("src"), none))
        .unionByName(each.filter("kind = 'node'").select(*own, node_of(F.col("child")).alias("src"), none))
        .unionByName(each.filter("kind = 'const'").select(*own, F.lit(None).cast("long").alias("src"), "num"))
    )
    members = stage_table(members, "members")
    nodes = stage_table(each.select("node_id", "func", "program").distinct(), "nodes")
    # The workbook's functions are a list of names, however many cells it has.
    funcs = sorted(r["func"] for r in nodes.select("func").distinct().collect())
    needs = members.select("node_id", "src").join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").select("node_id", "src").distinct()
    levels = [nodes.join(level, "node_id", "left_semi") for level in graph.peeled(nodes.select("node_id"), needs)]
    return Program(levels, members, funcs)


@F.pandas_udf(VALUE)
def _calculated(program: pd.Series, args: pd.Series) -> pd.DataFrame:
    read: dict[str, list] = {}
    out = []
    for text, given in zip(program, args, strict=True):
        if text not in read:
            read[text] = json.loads(text)
        steps = read[text]
        values: dict[int, object] = {}
        for a in given:
            values[a["arg"]] = a["txt"] if a["num"] is None else a["num"]
        x = expression.calculate(steps, [values.get(k) for k in range(1 + max((s[1] for s in steps if s[0] == "arg"), default=-1))])
        out.append((x, None) if isinstance(x, float) else (None, x))
    return pd.DataFrame(out, columns=["num", "txt"]).astype({"num": "float64", "txt": "object"})


def _evaluated(rows: DataFrame, keys: list[str], funcs: list[str]) -> DataFrame:
    """keys, node_id, num, txt of nodes from their members' values (keys, node_id, func, program, arg, num, txt)."""
    num, func = F.col("num"), F.col("func")
    only = lambda name: F.when(func == name, num)
    sums = [F.count("num").alias("n"), F.count(F.coalesce(num.cast("string"), F.col("txt"))).alias("filled"), F.sum("num").alias("s"), F.min("num").alias("low"), F.max("num").alias("high"), F.min(F.when(F.col("txt").startswith("#"), F.col("txt"))).alias("wrong")]
    # Only what the workbook's functions need is aggregated.
    if "MEDIAN" in funcs:
        sums.append(F.percentile(only("MEDIAN"), F.lit(0.5)).alias("mid"))
    for name, f in (("VAR", F.var_samp), ("VARP", F.var_pop), ("STDEV", F.stddev_samp), ("STDEVP", F.stddev_pop)):
        if name in funcs:
            sums.append(f(only(name)).alias(name))
    if "CALC" in funcs:
        sums.append(F.collect_list(F.when((func == "CALC") & F.col("arg").isNotNull(), F.struct("arg", "num", "txt"))).alias("args"))
    each = rows.groupBy(*keys, "node_id", "func", "program").agg(*sums)
    n, zero = F.col("n"), F.lit(0.0)
    result = {
        "SUM": F.coalesce(F.col("s"), zero),
        "COUNT": n.cast("double"),
        "COUNTA": F.col("filled").cast("double"),
        "AVERAGE": F.try_divide(F.col("s"), n),
        "MIN": F.coalesce(F.col("low"), zero),
        "MAX": F.coalesce(F.col("high"), zero),
    } | ({"MEDIAN": F.col("mid")} if "MEDIAN" in funcs else {}) | {k: F.col(k) for k in ("VAR", "VARP", "STDEV", "STDEVP") if k in funcs}
    value = F.lit(None).cast("double")
    for name, v in result.items():
        value = F.when(func == name, v).otherwise(value)
    counted = func.isin("COUNT", "COUNTA")
    wrong = F.when(F.col("wrong").isNotNull() & ~counted, F.col("wrong")).when(value.isNull() & (func != "CALC"), F.when(func == "MEDIAN", "#NUM!").otherwise("#DIV/0!"))
    plain = F.struct(F.when(wrong.isNull(), value).alias("num"), wrong.alias("txt"))
    if "CALC" not in funcs:
        return each.select(*keys, "node_id", plain.alias("v")).select(*keys, "node_id", "v.num", "v.txt")
    done = each.filter(func != "CALC").select(*keys, "node_id", plain.alias("v"))
    done = done.unionByName(each.filter(func == "CALC").select(*keys, "node_id", _calculated("program", "args").alias("v")))
    return done.select(*keys, "node_id", "v.num", "v.txt")


def present(g: graph.Graph, p: Program) -> DataFrame:
    """src, num, txt of every cell and node."""
    num, txt = typed(F.col("raw"))
    known = g.cells.join(g.formulas.select(F.col("formula_id").alias("cell_id")), "cell_id", "left_anti").select(F.col("cell_id").alias("src"), num.alias("num"), txt.alias("txt"))
    for nodes in p.levels:
        members = nodes.join(p.members.withColumnRenamed("num", "const"), "node_id", "left").join(known, "src", "left").withColumn("num", F.coalesce("num", "const"))
        known = known.unionByName(stage_table(_evaluated(members, [], p.funcs).withColumnRenamed("node_id", "src"), "values"))
    return known


def scenarios(p: Program, known: DataFrame, changed: DataFrame, boots: int, early: DataFrame) -> DataFrame:
    """range_id, boot_id, src, num, txt of every node downstream of a range, for each of its resamples.

    changed: range_id, boot_id, src, num, txt: the values that a range's cells have
    in a resample, formulas among them included. early: the same of nodes that are
    known already, of ranges that need no more of their cells.
    """
    keys = ["range_id", "boot_id"]
    touched = stage_table(changed.select("range_id", "src").unionByName(early.filter("boot_id = 0").select("range_id", "src")).distinct(), "touched")
    fixed = touched.withColumnRenamed("src", "node_id")
    values, made = changed.unionByName(early), early
    for nodes in p.levels:
        mine = nodes.join(p.members.withColumnRenamed("num", "const"), "node_id")
        hit = mine.select("node_id", "src").join(touched, "src").select("range_id", "node_id").distinct().join(fixed, ["range_id", "node_id"], "left_anti")
        hit = stage_table(hit, "hit")
        rows = hit.join(mine, "node_id").join(touched.withColumn("new", F.lit(True)), ["range_id", "src"], "left").join(known.withColumnsRenamed({"num": "num0", "txt": "txt0"}), "src", "left")
        rows = rows.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
        rows = rows.join(values, [*keys, "src"], "left").withColumn("num", F.coalesce(F.when(F.col("new"), F.col("num")).otherwise(F.col("num0")), "const")).withColumn("txt", F.when(F.col("new"), F.col("txt")).otherwise(F.col("txt0")))
        found = stage_table(_evaluated(rows, keys, p.funcs).withColumnRenamed("node_id", "src"), "scenario")
        values, touched = values.unionByName(found), touched.unionByName(hit.withColumnRenamed("node_id", "src"))
        made = made.unionByName(found)
    return made
