"""Queries of the dependency graph: formulas over nations, regions and a root, made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from . import formula
from .impact import table


def workbook(spark, sf_dir) -> DataFrame:
    """Column A: a value per nation. B: a formula per region over its nations. C: three roots over B and A, and two that read each other. D: sums over customers' segments of A."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    part = [
        nation.select((F.col("n_nationkey") + 1).alias("row"), F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("raw")),
        nation.groupBy("n_regionkey").agg(F.concat(F.lit("="), F.array_join(F.array_sort(F.collect_list(F.format_string("A%02d", F.col("n_nationkey") + 1))), "+")).alias("raw")).select((F.col("n_regionkey") + 1).alias("row"), F.lit(2).alias("col"), "raw"),
        region.select((F.col("r_regionkey") + 1).alias("row"), F.lit(4).alias("col"), F.concat(F.lit("=SUM($A"), F.col("r_regionkey") * 5 + 1, F.lit(":A$"), F.col("r_regionkey") * 5 + 5, F.lit(")*MAX('S'!A1:A2)")).alias("raw")),
        spark.createDataFrame([(1, 3, "=SUM(B1:B5)"), (2, 3, "=AVERAGE(A1:A25)+C1"), (3, 3, "=MEDIAN(D1:D5)+SUM(B1:C2)"), (4, 3, "=C5+1"), (5, 3, "=C4+A1")], "row int, col int, raw string"),
    ]
    rows = part[0]
    for p in part[1:]:
        rows = rows.unionByName(p)
    return rows.select((F.col("col").cast("long") * 1000 + F.col("row")).alias("cell_id"), F.lit("S").alias("worksheet"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "raw")


BOOK = """cells AS (SELECT (col * 1000 + r)::BIGINT AS cell_id, r::INT AS r, col::INT AS col, raw FROM (
  SELECT n_nationkey + 1 AS r, 1 AS col, n_nationkey::VARCHAR AS raw FROM nation
  UNION ALL SELECT n_regionkey + 1, 2, '=' || string_agg('A' || lpad((n_nationkey + 1)::VARCHAR, 2, '0'), '+' ORDER BY n_nationkey) FROM nation GROUP BY n_regionkey
  UNION ALL SELECT r_regionkey + 1, 4, '=SUM($A' || (r_regionkey * 5 + 1) || ':A$' || (r_regionkey * 5 + 5) || ')*MAX(''S''!A1:A2)' FROM region
  UNION ALL SELECT * FROM (VALUES (1, 3, '=SUM(B1:B5)'), (2, 3, '=AVERAGE(A1:A25)+C1'), (3, 3, '=MEDIAN(D1:D5)+SUM(B1:C2)'), (4, 3, '=C5+1'), (5, 3, '=C4+A1')))),
formulas AS (SELECT cell_id AS formula_id, replace(replace(raw, '$', ''), '''S''!', '') AS expr FROM cells WHERE starts_with(raw, '=')),
range_refs AS (SELECT formula_id, unnest(regexp_extract_all(expr, '[A-Z]+[0-9]+:[A-Z]+[0-9]+')) AS ref FROM formulas),
ranges AS (SELECT DISTINCT formula_id, regexp_extract(ref, '([0-9]+):', 1)::INT AS top, ascii(ref) - 64 AS lft, regexp_extract(ref, '([0-9]+)$', 1)::INT AS bottom, ascii(regexp_extract(ref, ':([A-Z])', 1)) - 64 AS rgt FROM range_refs),
vectors AS (SELECT DISTINCT top, lft, bottom, rgt FROM ranges),
v2i AS (SELECT top, lft, bottom, rgt, ((r - top) * (rgt - lft + 1) + col - lft)::INT AS idx, cell_id FROM vectors JOIN cells ON r BETWEEN top AND bottom AND col BETWEEN lft AND rgt),
single_refs AS (SELECT formula_id, unnest(regexp_extract_all(regexp_replace(expr, '[A-Z]+[0-9]+:[A-Z]+[0-9]+', ' ', 'g'), '[A-Z][0-9]+')) AS ref FROM formulas),
f2i AS (SELECT DISTINCT formula_id, cell_id FROM single_refs JOIN cells ON col = ascii(ref) - 64 AND r = substr(ref, 2)::INT),
inputs AS (SELECT formula_id, cell_id FROM ranges JOIN v2i USING (top, lft, bottom, rgt) UNION SELECT * FROM f2i)"""


def acyclic(spark, sf_dir) -> DataFrame:
    return workbook(spark, sf_dir).filter("NOT (col = 3 AND row >= 4)")


ACYCLIC = BOOK.replace(", (4, 3, '=C5+1'), (5, 3, '=C4+A1')", "")


def graph_formulas(spark, sf_dir):
    return graph.scan(workbook(spark, sf_dir)).select("formula_id", "expr")


def graph_functions(spark, sf_dir):
    return formula.functions(graph.scan(workbook(spark, sf_dir)))


def graph_vectors(spark, sf_dir):
    return graph.build(workbook(spark, sf_dir)).vectors.select("top", "left", "bottom", "right", "height", "width", "perturbable")


def graph_formula_vectors(spark, sf_dir):
    g = graph.build(workbook(spark, sf_dir))
    return g.f2v.join(g.vectors, "range_id").select("formula_id", "top", "left", "bottom", "right")


def graph_vector_cells(spark, sf_dir):
    g = graph.build(workbook(spark, sf_dir))
    return g.v2i.join(g.vectors, "range_id").select("top", "left", "bottom", "right", "idx", "cell_id")


def graph_formula_cells(spark, sf_dir):
    return graph.build(workbook(spark, sf_dir)).f2i


def graph_edges(spark, sf_dir):
    return graph.inputs(graph.build(workbook(spark, sf_dir)))


def graph_terminal_formulas(spark, sf_dir):
    return graph.terminal_formulas(graph.build(workbook(spark, sf_dir)))


def graph_terminal_vectors(spark, sf_dir):
    g = graph.build(workbook(spark, sf_dir))
    return graph.terminal_vectors(g).join(g.vectors, "range_id").select("top", "left", "bottom", "right")


def graph_computation_cells(spark, sf_dir):
    return graph.computation_cells(graph.build(workbook(spark, sf_dir)))


def graph_input_count(spark, sf_dir):
    return graph.computation_cells(graph.build(workbook(spark, sf_dir))).agg(F.count("*").alias("n_inputs"))


def graph_leaf_cells(spark, sf_dir):
    return graph.leaf_cells(graph.build(acyclic(spark, sf_dir)))


def graph_path_weights(spark, sf_dir):
    return graph.weights(graph.build(acyclic(spark, sf_dir)))


def graph_loops(spark, sf_dir):
    return graph.loops(graph.build(workbook(spark, sf_dir)))


def graph_addresses(spark, sf_dir):
    """A cell for each part, over all columns of a sheet, as A1 text and back."""
    n = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 16384 + 1).cast("int").alias("col"), (F.col("p_partkey") % 1000 + 1).cast("int").alias("row"))
    return n.select("p_partkey", "col", formula.a1(F.col("row"), F.col("col")).alias("address")).withColumn("back", formula.column_number(F.regexp_extract("address", "^([A-Z]+)", 1)))


def dot_export(spark, sf_dir):
    """Edges between cells and formulas as DOT lines; vectors are named by a hash, so only their count is compared."""
    lines = graph.dot(graph.build(workbook(spark, sf_dir)))
    kind = F.when(F.col("line").startswith("r"), "vector to formula").when(F.col("line").contains("-> r"), "cell to vector").otherwise(F.col("line"))
    return lines.groupBy(kind.alias("line")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (graph_formulas, graph_functions, graph_vectors, graph_formula_vectors, graph_vector_cells, graph_formula_cells, graph_edges, graph_terminal_formulas, graph_terminal_vectors, graph_computation_cells, graph_input_count, graph_leaf_cells, graph_path_weights, graph_loops, graph_addresses, dot_export)}

_NAMES = 'top, lft AS "left", bottom, rgt AS "right"'
_PERTURBABLE = "marked AS (SELECT top, lft, bottom, rgt, bool_or(cell_id NOT IN (SELECT formula_id FROM formulas)) AS perturbable FROM v2i GROUP BY ALL)"
#: A cell in two ranges of a formula is two ways to it.
_PATHS = f"WITH RECURSIVE {ACYCLIC}, reads AS (SELECT formula_id, cell_id FROM ranges JOIN v2i USING (top, lft, bottom, rgt) UNION ALL SELECT * FROM f2i), paths AS (SELECT formula_id, cell_id FROM reads UNION ALL SELECT p.formula_id, i.cell_id FROM paths p JOIN reads i ON p.cell_id = i.formula_id), leaves AS (SELECT * FROM paths WHERE cell_id NOT IN (SELECT formula_id FROM formulas))"
SQL = {
    "graph_formulas": f"WITH {BOOK} SELECT cell_id AS formula_id, raw AS expr FROM cells WHERE starts_with(raw, '=')",
    "graph_functions": f"WITH {BOOK} SELECT DISTINCT formula_id, unnest(regexp_extract_all(expr, '([A-Z][A-Z0-9.]*)\\(', 1)) AS function FROM formulas",
    "graph_vectors": f"WITH {BOOK}, {_PERTURBABLE} SELECT {_NAMES}, bottom - top + 1 AS height, rgt - lft + 1 AS width, perturbable FROM vectors JOIN marked USING (top, lft, bottom, rgt)",
    "graph_formula_vectors": f"WITH {BOOK} SELECT formula_id, {_NAMES} FROM ranges",
    "graph_vector_cells": f"WITH {BOOK} SELECT {_NAMES}, idx, cell_id FROM v2i",
    "graph_formula_cells": f"WITH {BOOK} SELECT * FROM f2i",
    "graph_edges": f"WITH {BOOK} SELECT * FROM inputs",
    "graph_terminal_formulas": f"WITH {BOOK} SELECT formula_id FROM formulas WHERE formula_id NOT IN (SELECT cell_id FROM inputs)",
    "graph_terminal_vectors": f"WITH {BOOK}, {_PERTURBABLE} SELECT {_NAMES} FROM marked WHERE perturbable",
    "graph_computation_cells": f"WITH {BOOK} SELECT DISTINCT cell_id FROM inputs",
    "graph_input_count": f"WITH {BOOK} SELECT count(DISTINCT cell_id) AS n_inputs FROM inputs",
    "graph_leaf_cells": f"{_PATHS} SELECT DISTINCT cell_id FROM leaves",
    "graph_path_weights": f"{_PATHS} SELECT formula_id AS cell_id, count(*) AS weight FROM leaves GROUP BY formula_id UNION ALL SELECT DISTINCT cell_id, 1 FROM leaves",
    "graph_loops": f"WITH RECURSIVE {BOOK}, reach AS (SELECT formula_id, cell_id FROM inputs UNION SELECT r.formula_id, i.cell_id FROM reach r JOIN inputs i ON r.cell_id = i.formula_id) SELECT f.formula_id, EXISTS (SELECT 1 FROM reach r WHERE r.formula_id = f.formula_id AND r.cell_id = f.formula_id) AS in_loop FROM formulas f",
    "graph_addresses": """WITH n AS (SELECT p_partkey, (p_partkey * 7 % 16384 + 1)::INT AS col, (p_partkey % 1000 + 1)::INT AS r FROM part)
SELECT p_partkey, col, CASE WHEN col > 702 THEN chr(65 + ((col - 703) // 676)::INT) ELSE '' END || CASE WHEN col > 26 THEN chr(65 + (((col - 27) // 26) % 26)::INT) ELSE '' END || chr(65 + ((col - 1) % 26)::INT) || r AS address, col AS back FROM n""",
    "dot_export": f"""WITH {BOOK} SELECT 'c' || cell_id || ' -> c' || formula_id || ';' AS line, 1::BIGINT AS n FROM f2i UNION ALL SELECT 'vector to formula', count(*) FROM ranges UNION ALL SELECT 'cell to vector', count(*) FROM v2i""",
}
