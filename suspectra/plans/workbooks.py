"""Queries from a workbook to scores: customers' balances by nation as ranges, nested formulas over them, numbers and texts as outputs.

Column k + 1 has the balances of nation k, in cents; the first of each is too large.
AA has a formula over each of these ranges (SUM, a rounded AVERAGE or MEDIAN, in
turns), AB the sums of AA by region, AC texts that depend on AA. Nations of fewer
than three customers are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import sql_draw
from ..operators import cutoff, evaluate, graph, inference, simulate
from . import formula
from .impact import HIGH, LOW, SEED, SIG, table

BOOTS, LIMIT, ROW = 200, 100_000, 1_000_000


def workbook(spark, sf_dir) -> DataFrame:
    """cell_id (column * ROW + row), worksheet, row, col, raw."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    many = customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).filter("n >= 3")
    ranked = customer.join(many, "c_nationkey").withColumn("row", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    k = F.col("c_nationkey").cast("int")
    cents = F.round(F.col("c_acctbal") * 100).cast("long") * F.when(F.col("row") == 1, 50 * (k + 1)).otherwise(1)
    inputs = ranked.select("row", (k + 1).alias("col"), cents.cast("string").alias("raw"))
    area = F.concat(formula.a1(F.lit(1), k + 1), F.lit(":"), formula.a1(F.col("n"), k + 1))
    first = F.when(k % 3 == 0, F.concat(F.lit("=SUM("), area, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("=ROUND(AVERAGE("), area, F.lit("),0)"))).otherwise(F.concat(F.lit("=MEDIAN("), area, F.lit(")")))
    level1 = many.select((k + 1).alias("row"), F.lit(27).alias("col"), first.alias("raw"))
    names = many.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.format_string("AA%02d", k + 1).alias("name"))
    level2 = names.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("name")), "+").alias("sum")).select((F.col("n_regionkey").cast("int") + 1).alias("row"), F.lit(28).alias("col"), F.concat(F.lit("="), "sum").alias("raw"))
    texts = many.filter(k % 4 == 0).select((k + 1).alias("row"), F.lit(29).alias("col"), F.concat(F.lit("=IF(AA"), k + 1, F.lit(f'>{LIMIT},"high","low")&"!"')).alias("raw"))
    every = inputs.unionByName(level1).unionByName(level2).unionByName(texts)
    return every.select((F.col("col").cast("long") * ROW + F.col("row")).alias("cell_id"), F.lit("S").alias("worksheet"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "raw")


def _first(values: str) -> str:
    """AA's formula over v in a grouping by nation k."""
    return f"CASE k % 3 WHEN 0 THEN sum({values}) WHEN 1 THEN sign(avg({values})) * floor(abs(avg({values})) + 0.5::DOUBLE) ELSE quantile_cont({values}, 0.5) END"


CELLS = f"""ranked AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, round(c_acctbal * 100)::BIGINT AS cents FROM customer),
cells AS (SELECT k, (r - 1)::INT AS idx, ((k + 1) * {ROW} + r)::BIGINT AS cell_id, (cents * CASE WHEN r = 1 THEN 50 * (k + 1) ELSE 1 END)::DOUBLE AS v, n, 'S:1:' || (k + 1) || ':' || n || ':' || (k + 1) AS name FROM ranked WHERE n >= 3),
whole AS (SELECT k, n, ({_first("v")})::DOUBLE AS f FROM cells GROUP BY k, n),
regions AS (SELECT n_regionkey AS g, sum(f) AS f, sum(n)::BIGINT AS weight FROM whole JOIN nation ON n_nationkey = k GROUP BY n_regionkey)"""
TEXT = "CASE WHEN {0} > " + str(LIMIT) + " THEN 'high!' ELSE 'low!' END"

VALUES_SQL = f"""WITH {CELLS}, vals AS (SELECT 27 * {ROW}::BIGINT + k + 1 AS cell_id, f FROM whole UNION ALL SELECT 28 * {ROW}::BIGINT + g + 1, f FROM regions)
SELECT cell_id, CASE WHEN f = floor(f) THEN f::BIGINT::VARCHAR ELSE f::VARCHAR END AS value FROM vals UNION ALL SELECT 29 * {ROW}::BIGINT + k + 1, {TEXT.format("f")} FROM whole WHERE k % 4 = 0"""

_CUT = lambda x: f"trunc(({x}) * 10000) / 10000.0::DOUBLE"
SCORES = f"""{CELLS},
boot_ids AS (SELECT b::INT AS boot_id FROM range({BOOTS}) t(b)),
draws AS (SELECT k, n, name, boot_id, ({sql_draw(SEED, "name", "boot_id", "idx", "n")})::INT AS idx FROM cells, boot_ids),
boots AS (SELECT d.k, boot_id, ({_first("v")})::DOUBLE AS f FROM (SELECT d.k AS k, d.boot_id, c.v FROM draws d JOIN cells c ON c.k = d.k AND c.idx = d.idx) d GROUP BY d.k, boot_id),
left_out AS (SELECT c.k, c.idx, c.cell_id, boot_id FROM cells c, boot_ids WHERE NOT EXISTS (SELECT 1 FROM draws d WHERE d.k = c.k AND d.boot_id = boot_ids.boot_id AND d.idx = c.idx)),
outputs AS (SELECT k, g, weight, r.f AS original, r.f - w.f AS rest FROM whole w JOIN nation ON n_nationkey = k JOIN regions r ON g = n_regionkey),
placed AS (SELECT l.k, l.idx, l.cell_id, b.f + o.rest AS value, row_number() OVER (PARTITION BY l.k, l.idx ORDER BY b.f, l.boot_id) - 1 AS pos, count(*) OVER (PARTITION BY l.k, l.idx) AS m FROM left_out l JOIN boots b USING (k, boot_id) JOIN outputs o USING (k)),
bands AS (SELECT k, idx, {_CUT(f"max(CASE WHEN pos = floor((m - 1) * {LOW!r}::DOUBLE) THEN value END)")} AS lo, {_CUT(f"max(CASE WHEN pos = ceil((m - 1) * {HIGH!r}::DOUBLE) THEN value END)")} AS hi, {_CUT("min(value)")} AS mn, {_CUT("max(value)")} AS mx FROM placed GROUP BY k, idx),
tested AS (SELECT cell_id, g, weight, {_CUT("original")} AS o, lo, hi, mn, mx FROM cells JOIN outputs USING (k) JOIN bands USING (k, idx)),
numbers AS (SELECT cell_id, 28 * {ROW}::BIGINT + g + 1 AS output_id, weight, CASE WHEN o > hi THEN CASE WHEN mx <> hi THEN abs(o - hi) / abs(hi - mx) ELSE abs(o - hi) END
  WHEN o < lo THEN CASE WHEN mn <> lo THEN abs(o - lo) / abs(lo - mn) ELSE abs(o - lo) END ELSE 0.0::DOUBLE END AS outlierness FROM tested),
texts AS (SELECT l.cell_id, 29 * {ROW}::BIGINT + k + 1 AS output_id, any_value(w.n) AS weight, avg(CASE WHEN {TEXT.format("b.f")} = {TEXT.format("w.f")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM left_out l JOIN boots b USING (k, boot_id) JOIN whole w USING (k) WHERE k % 4 = 0 GROUP BY l.cell_id, k),
scores AS (SELECT cell_id, output_id, true AS numeric, outlierness, NULL::DOUBLE AS p, floor(weight * outlierness)::BIGINT AS score FROM numbers
  UNION ALL SELECT cell_id, output_id, false, NULL, p, (CASE WHEN p < {1 - SIG!r}::DOUBLE THEN weight ELSE 0 END)::BIGINT FROM texts),
merged AS (SELECT cell_id, sum(score)::BIGINT AS score FROM scores GROUP BY cell_id)"""


def workbook_values(spark, sf_dir):
    """What every formula shows, as text."""
    g = graph.build(workbook(spark, sf_dir))
    known = evaluate.present(g, evaluate.compiled(g))
    return known.join(g.formulas.select(F.col("formula_id").alias("src")), "src", "left_semi").select(F.col("src").alias("cell_id"), evaluate.as_text(F.col("num"), F.col("txt")).alias("value"))


def workbook_outputs(spark, sf_dir):
    """The prepared simulation's outputs: formulas that nothing reads."""
    return simulate.prepare(workbook(spark, sf_dir))[2]


def workbook_scores(spark, sf_dir):
    """Scores of every input on every output that depends on it; numbers and texts are told apart by their values."""
    return inference.analyze_workbook(workbook(spark, sf_dir), BOOTS, SIG, SEED).drop("range_id")


def workbook_flagged(spark, sf_dir):
    """From a workbook to the cells to inspect."""
    scores = inference.merge(inference.analyze_workbook(workbook(spark, sf_dir), BOOTS, SIG, SEED))
    return cutoff.above_significance(scores, SIG)


QUERIES = {f.__name__: f for f in (workbook_values, workbook_outputs, workbook_scores, workbook_flagged)}

SQL = {
    "workbook_values": VALUES_SQL,
    "workbook_outputs": f"SELECT * FROM ({VALUES_SQL}) WHERE cell_id >= 28 * {ROW}::BIGINT",
    "workbook_scores": f"WITH {SCORES} SELECT * FROM scores",
    "workbook_flagged": f"""WITH {SCORES}, ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) - 1 AS pos, count(*) OVER () AS n FROM merged)
SELECT cell_id, score FROM ordered WHERE score >= (SELECT score FROM ordered WHERE pos = least(n - round_even(n * {SIG!r}::DOUBLE, 0), n - 1)) AND score <> 0""",
}
