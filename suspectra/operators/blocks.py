"""Ranges of a workbook by blocks: a task resamples a range some times, and tests some of its positions.

Between the two only a bit for each position and resample is written, and what the
formulas over the range give. This holds for ranges of numbers and blanks whose cells
are read by SUM, COUNT, COUNTA, AVERAGE, MEDIAN, MIN and MAX over cells of the range
only; ``slow`` tells the others, which take a row for each draw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..sources.staging import stage_table
from . import evaluate as workbook
from . import local

FUNCS = ("SUM", "COUNT", "COUNTA", "AVERAGE", "MEDIAN", "MIN", "MAX")
#: Draws of a task, and positions that are tested together.
DRAWS, WIDTH = 1 << 24, 1 << 15
MADE = "range_id long, first int, boots int, block int, bits binary, src long, boot_id int, num double, txt string"
TESTED = "cell_id long, range_id long, output_id long, evidence boolean, low double, high double, least double, most double, p double"


def _readers(p: workbook.Program, placed: DataFrame) -> DataFrame:
    """range_id, idx, node_id, func, alone: what reads a range's cells, and whether it does in a form that a task takes."""
    nodes = None
    for level in p.levels:
        nodes = level.select("node_id", "func") if nodes is None else nodes.unionByName(level.select("node_id", "func"))
    met = p.members.select("node_id", "src").join(placed.select("range_id", "idx", F.col("cell_id").alias("src")), "src")
    inside = met.groupBy("range_id", "node_id").agg(F.count("*").alias("n"))
    every = p.members.groupBy("node_id").agg(F.count("*").alias("every"))
    facts = inside.join(every, "node_id").join(nodes, "node_id").select("range_id", "node_id", "func", ((F.col("n") == F.col("every")) & F.col("func").isin(*FUNCS)).alias("alone"))
    return met.select("range_id", "idx", "node_id").join(facts, ["range_id", "node_id"])


def slow(p: workbook.Program, known: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the ranges that need a row for each draw, the readers of cells)."""
    readers = stage_table(_readers(p, placed), "readers")
    cells = placed.select("range_id", F.col("cell_id").alias("src"))
    texts = cells.join(known.filter("txt IS NOT NULL").select("src"), "src", "left_semi").select("range_id")
    found = readers.filter(~F.col("alone")).select("range_id").unionByName(texts)
    for level in p.levels:
        found = found.unionByName(cells.join(level.select(F.col("node_id").alias("src")), "src", "left_semi").select("range_id"))
    return stage_table(found.distinct(), "slow"), readers


def _resampled(key: tuple, rows: pa.Table, seed: int) -> pa.Table:
    first, boots = (rows.column(c)[0].as_py() for c in ("first", "boots"))
    slots = rows.column("idx").to_numpy().astype(np.int64)
    n = len(slots)
    v, there = np.zeros(n), np.zeros(n, dtype=bool)
    v[slots], there[slots] = local.numbers_of(rows.column("num"))
    readers = rows.column("readers").combine_chunks()
    nodes: dict[int, tuple[str, np.ndarray]] = {}
    flat = readers.flatten()
    if len(flat):
        of = slots[pc.list_parent_indices(readers).to_numpy()]
        ids, funcs = (flat.field(k).to_numpy() for k in (0, 1))
        order = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[order])) + 1
        for some in np.split(order, cuts):
            nodes[int(ids[some[0]])] = (FUNCS[funcs[some[0]]], of[some])
    names, same = [rows.column("key")[0].as_py().encode()], np.zeros(n, dtype=np.int64)
    step, every = max(1, local.HELD // n), np.arange(n)
    left_out = np.ones((boots, n), dtype=bool)
    made: dict[int, list] = {k: [] for k in nodes}
    for r in range(0, boots, step):
        upto = min(r + step, boots)
        at = digests.draws(seed, names, same, np.arange(first + r, first + upto), every, np.full(n, n))
        left_out[np.arange(r, upto)[:, None], at] = False
        for node, (func, where) in nodes.items():
            formula = "COUNT" if func == "COUNTA" else func
            mine = at if len(where) == n and len(np.unique(where)) == n else at[:, where]
            made[node].append(local.aggregated(formula, v, there, mine))
    out: list[dict] = []
    for block, a in enumerate(range(0, n, WIDTH)):
        out.append({"first": first, "boots": boots, "block": block, "bits": np.packbits(left_out[:, a : a + WIDTH], axis=1).tobytes()})
    for node, parts in made.items():
        func = nodes[node][0]
        value, some = (np.concatenate(x) for x in zip(*parts, strict=True))
        none = {"AVERAGE": "#DIV/0!", "MEDIAN": "#NUM!"}.get(func)
        for k, (x, has) in enumerate(zip(value.tolist(), some.tolist(), strict=True)):
            wrong = None if has else none
            out.append({"src": node, "boot_id": first + k, "num": None if wrong else (x if has else 0.0), "txt": wrong})
    range_id = key[0].as_py()
    return pa.Table.from_pylist([{"range_id": range_id, **row} for row in out], schema=_arrow(MADE))


def _arrow(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def resampled(placed: DataFrame, known: DataFrame, readers: DataFrame, boots: int, seed: int) -> DataFrame:
    """MADE: bits of the positions that resamples leave out, by block; and the values of the nodes that read them. placed: range_id, idx, cell_id, key."""
    which = F.array_position(F.array(*map(F.lit, FUNCS)), F.col("func")).cast("int") - 1
    reads = readers.groupBy("range_id", "idx").agg(F.collect_list(F.struct("node_id", which.alias("func"))).alias("readers"))
    cells = placed.join(known.select(F.col("src").alias("cell_id"), "num"), "cell_id").join(reads, ["range_id", "idx"], "left")
    sizes = placed.groupBy("range_id").agg(F.count("*").alias("n")).withColumn("step", F.greatest(F.lit(1), F.least(F.lit(boots), F.floor(F.lit(DRAWS) / F.col("n")))).cast("int"))
    parts = sizes.select("range_id", F.col("step"), F.explode(F.sequence(F.lit(0), F.floor((F.lit(boots - 1)) / F.col("step")).cast("int"))).alias("part"))
    parts = parts.select("range_id", (F.col("part") * F.col("step")).alias("first"), F.least(F.col("step"), F.lit(boots) - F.col("part") * F.col("step")).alias("boots"))
    dealt = cells.select("range_id", "key", "idx", "num", "readers").join(parts, "range_id")

    def run(key, rows):
        return _resampled(key, rows, seed)

    return stage_table(dealt.groupBy("range_id", "first").applyInArrow(run, MADE), "resampled")


def tested(placed: DataFrame, made: DataFrame, results: DataFrame, boots: int, low_share: float, high_share: float) -> DataFrame:
    """TESTED: bands (numbers) or p (texts) of each cell and output, and a row without an output for each cell: whether some resample leaves it out.

    results: range_id, output_id, numeric, boot_id, num, same (as the original).
    """
    bits = made.filter("bits IS NOT NULL").select("range_id", "block", "first", "boots", "bits")
    slots = F.collect_list(F.struct("boot_id", "num", "same"))
    outputs = results.groupBy("range_id", "output_id", "numeric").agg(F.array_sort(slots).alias("values"))
    blocks = bits.select("range_id", "block").distinct()
    more = blocks.join(outputs, "range_id")
    right = bits.unionByName(more, allowMissingColumns=True)
    left = placed.select("range_id", "idx", "cell_id", F.floor(F.col("idx") / WIDTH).cast("int").alias("block"))

    def run(cells: pa.Table, other: pa.Table) -> pa.Table:
        column = (cells.column("idx").to_numpy() % WIDTH).astype(np.int64)
        width = len(column)
        out = np.zeros((boots, width), dtype=bool)
        for row in other.filter(pc.is_valid(other.column("bits"))).select(["first", "boots", "bits"]).to_pylist():
            packed = np.frombuffer(row["bits"], dtype=np.uint8).reshape(row["boots"], -1)
            out[row["first"] : row["first"] + row["boots"]] = np.unpackbits(packed, axis=1, count=width).astype(bool)
        base = [cells.column("cell_id"), cells.column("range_id")]
        evidence = out.any(axis=0)[column]
        none = pa.nulls(width, pa.float64())
        tables = [pa.table([*base, pa.nulls(width, pa.int64()), pa.array(evidence), *[none] * 5], schema=schema)]
        for row in other.filter(pc.is_valid(other.column("output_id"))).select(["output_id", "numeric", "values"]).to_pylist():
            at = np.array([x["boot_id"] for x in row["values"]])
            of, p = [none] * 4, none
            if row["numeric"]:
                value = np.array([x["num"] for x in row["values"]], dtype=np.float64)
                *four, many = local.bands(out[at], value, np.ones(len(at), dtype=bool), low_share, high_share)
                of = [pa.array(x[column], mask=many[column] == 0) for x in four]
            else:
                same = np.array([x["same"] for x in row["values"]], dtype=bool)
                many = out[at].sum(axis=0)
                p = pa.array((out[at[same]].sum(axis=0) / np.maximum(many, 1))[column], mask=many[column] == 0)
            tables.append(pa.table([*base, pa.array(np.full(width, row["output_id"]), pa.int64()), pa.array(evidence), *of, p], schema=schema))
        return pa.concat_tables(tables)

    schema = _arrow(TESTED)
    return left.groupBy("range_id", "block").cogroup(right.groupBy("range_id", "block")).applyInArrow(run, TESTED)
