"""Queries of crowd retyping, alignment, the typing-error model, generated errors and the simulated audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import align_udf, dealt, lcs_length_udf, subsequences_udf
from ..operators import crowd, inference, simulate, typo_model
from ..operators.cutoff import Cutoff
from .impact import BOOTS, CELLS, cells, table

#: Part of a wide crowd row before the items, and fields of an item.
HEAD = crowd.ITEMS_AT


def retyped(spark, sf_dir) -> DataFrame:
    """Part names as retyped by seven workers; some with a letter dropped, doubled or swapped with the next."""
    p = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    at = F.col("p_partkey") % 5 + 2
    left = lambda n: F.substring(name, F.lit(1), n)
    one = lambda n: F.substring(name, n, F.lit(1))
    rest = lambda n: F.substring(name, n, F.char_length(name))
    typed = F.when(k % 11 == 0, F.concat(left(at - 1), rest(at + 1))).when(k % 13 == 0, F.concat(left(at), rest(at))).when(k % 17 == 0, F.concat(left(at - 1), one(at + 1), one(at), rest(at + 2))).otherwise(name)
    return p.select(F.concat(F.lit("w"), k % 7).alias("worker_id"), k.alias("cell_id"), name.alias("original"), typed.alias("retyped"))


RETYPED = """retyped AS (SELECT 'w' || p_partkey % 7 AS worker_id, p_partkey AS cell_id, p_name AS original,
  CASE WHEN p_partkey % 11 = 0 THEN substr(p_name, 1, p_partkey % 5 + 1) || substr(p_name, p_partkey % 5 + 3)
       WHEN p_partkey % 13 = 0 THEN substr(p_name, 1, p_partkey % 5 + 2) || substr(p_name, p_partkey % 5 + 2)
       WHEN p_partkey % 17 = 0 THEN substr(p_name, 1, p_partkey % 5 + 1) || substr(p_name, p_partkey % 5 + 3, 1) || substr(p_name, p_partkey % 5 + 2, 1) || substr(p_name, p_partkey % 5 + 4)
       ELSE p_name END AS retyped FROM part)"""


def _wide(spark, sf_dir) -> DataFrame:
    """Two items a row, in the layout of a crowd file."""
    r = retyped(spark, sf_dir).withColumn("half", F.col("cell_id") % 2).withColumn("pair", F.floor(F.col("cell_id") / 2))
    one = r.groupBy("pair").agg(*[F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{c}{h}") for h in (0, 1) for c in ("worker_id", "cell_id", "original", "retyped")]).filter("cell_id0 IS NOT NULL AND cell_id1 IS NOT NULL")
    head = [F.col("worker_id0") if k == crowd.WORKER_AT else F.lit(f"h{k}") for k in range(HEAD)]
    item = lambda h: [F.lit("path"), F.lit("book"), F.lit("sheet"), F.col(f"cell_id{h}").cast("string"), F.lit(str(h + 1)), F.col(f"original{h}"), F.lit("url")]
    columns = [*head, *item(0), *item(1), F.col("retyped0"), F.col("retyped1")]
    return one.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)])


def crowd_unpivot(spark, sf_dir):
    return crowd.unpivot(_wide(spark, sf_dir))


def crowd_accuracy(spark, sf_dir):
    return crowd.accuracy(retyped(spark, sf_dir))


def crowd_by_worker(spark, sf_dir):
    return crowd.by_worker(retyped(spark, sf_dir))


def crowd_busiest(spark, sf_dir):
    return crowd.busiest(retyped(spark, sf_dir))


def crowd_pairs(spark, sf_dir):
    return crowd.pairs(retyped(spark, sf_dir))


def char_error_rate(spark, sf_dir):
    return crowd.char_error_rate(retyped(spark, sf_dir)).select(F.round("char_error_rate", 9).alias("char_error_rate"))


def _typo(spark, sf_dir) -> DataFrame:
    """A count table by position: the original's characters and what stands there in the retyped text."""
    r = retyped(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(1), F.char_length("original"))).alias("k")
    each = r.select("original", "retyped", k).select(F.substring(F.col("original"), F.col("k"), F.lit(1)).alias("intended"), F.substring(F.col("retyped"), F.col("k"), F.lit(1)).alias("typed"))
    return each.groupBy("intended", "typed").agg(F.count("*").alias("n"))


TYPO = f"{RETYPED}, typo AS (SELECT intended, typed, count(*) AS n FROM (SELECT substr(original, k, 1) AS intended, substr(retyped, k, 1) AS typed FROM (SELECT original, retyped, unnest(range(1, length(original) + 1)) AS k FROM retyped)) GROUP BY ALL)"


def typo_distribution(spark, sf_dir):
    return typo_model.typo_distribution(_typo(spark, sf_dir))


def transposition_distribution(spark, sf_dir):
    moves = retyped(spark, sf_dir).groupBy((F.char_length("retyped") - F.char_length("original")).alias("delta")).agg(F.count("*").alias("n"))
    return typo_model.transposition_distribution(moves)


def lcs_length(spark, sf_dir):
    return dealt(retyped(spark, sf_dir), "cell_id").select("cell_id", lcs_length_udf("original", "retyped").alias("length"))


def lcs_align(spark, sf_dir):
    return dealt(retyped(spark, sf_dir), "cell_id").select("cell_id", align_udf("original", "retyped").alias("pairs"))


def lcs_strings(spark, sf_dir):
    return dealt(retyped(spark, sf_dir), "cell_id").select("cell_id", subsequences_udf("original", "retyped").alias("strings"))


def typo_train(spark, sf_dir):
    return typo_model.train(retyped(spark, sf_dir))[0]


def transposition_train(spark, sf_dir):
    return typo_model.train(retyped(spark, sf_dir))[1]


def typo_counts(spark, sf_dir):
    return typo_model.counts(retyped(spark, sf_dir))


def _model(spark, sf_dir):
    return typo_model.load(*typo_model.train(retyped(spark, sf_dir)))


def _inputs(spark, sf_dir) -> DataFrame:
    """Prices as text, and names, which the model knows."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("cell_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("raw"))


def error_strings(spark, sf_dir):
    return typo_model.error_strings(_inputs(spark, sf_dir), _model(spark, sf_dir), 3)


def _candidates(spark, sf_dir) -> DataFrame:
    """Candidate values of customers' balances, without a model: digits repeated, dropped or moved by rule."""
    c = cells(spark, sf_dir).select("cell_id", F.col("v").cast("string").alias("raw"))
    n = F.char_length("raw")
    wrong = F.array(F.concat("raw", F.lit("0")), F.substring(F.col("raw"), F.lit(1), n - 1), F.concat(F.substring(F.col("raw"), F.lit(1), n - 1), F.lit("9")))
    return c.select("cell_id", "raw", F.posexplode(wrong).alias("candidate", "value"))


def important_errors(spark, sf_dir):
    return typo_model.important_errors(typo_model.effect_on_sum(_candidates(spark, sf_dir)))


def top_of_k(spark, sf_dir):
    return typo_model.top_of_k(typo_model.effect_on_sum(_candidates(spark, sf_dir)))


EFFECTS = """base AS (SELECT c_custkey AS cell_id, (round(c_acctbal * 100)::BIGINT * CASE WHEN c_custkey % 97 = 0 THEN 1000 ELSE 1 END)::VARCHAR AS raw FROM customer),
cands AS (SELECT cell_id, raw, unnest([0, 1, 2]) AS candidate, unnest([raw || '0', substr(raw, 1, length(raw) - 1), substr(raw, 1, length(raw) - 1) || '9']) AS value FROM base),
effects AS (SELECT *, CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN abs(try_cast(raw AS DOUBLE) - try_cast(value AS DOUBLE)) ELSE 1.0 END AS effect FROM cands),
best AS (SELECT cell_id, value, effect FROM effects QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY effect DESC, candidate) = 1)"""


def single_errors(spark, sf_dir):
    """Replicates of one error each, in hashed order."""
    return simulate.pick_single_errors(cells(spark, sf_dir), _candidates(spark, sf_dir), 100)


def _slice(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Clean balances, and errors a thousand times as large in every 701st."""
    c = cells(spark, sf_dir)
    clean = c.withColumn("v", F.when(F.col("cell_id") % 97 == 0, (F.col("v") / 1000).cast("long")).otherwise(F.col("v")))
    return clean, clean.filter("cell_id % 701 = 0").select("cell_id", (F.col("v") * 1000).cast("double").alias("value"))


def simulate_audit(spark, sf_dir):
    """The iterations of an audit by bootstrap and of one by each normal baseline, each until nothing is flagged."""
    clean, errors = _slice(spark, sf_dir)
    parts = [simulate.iterations(spark, simulate.audit(clean, errors, d, Cutoff("quantile", 0.10), boots=BOOTS)) for d in ("bootstrap", "normal_per_range", "normal_all")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def simulation_report(spark, sf_dir):
    clean, errors = _slice(spark, sf_dir)
    rows = [simulate.report(clean, errors, simulate.audit(clean, errors, d, Cutoff("quantile", 0.10), boots=BOOTS), d) for d in ("bootstrap", "normal_all")]
    return rows[0].unionAll(rows[1])


def crowd_by_accuracy(spark, sf_dir):
    """Workers, the most accurate first; their place is a column."""
    return crowd.by_accuracy(retyped(spark, sf_dir)).withColumn("place", F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "worker_id")))


def signs(spark, sf_dir):
    """The sign of balances as they are written."""
    raw = F.when(F.col("v") > 500_000, F.concat(F.lit("+"), "v")).otherwise(F.col("v").cast("string"))
    return cells(spark, sf_dir).select("cell_id", raw.alias("raw")).select("cell_id", typo_model.sign_of().alias("sign"))


#: Row by row of the table of lengths: the best of the row above, of a match's diagonal, and of what is left of it.
LCS_SQL = f"""WITH RECURSIVE {RETYPED}, pairs AS (SELECT DISTINCT original AS x, retyped AS y FROM retyped),
rows AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS last FROM pairs
  UNION ALL SELECT x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(steps[1:j])) FROM (
    SELECT x, y, i, list_transform(range(1, length(y) + 2), lambda j: CASE WHEN j > 1 AND substr(y, j - 1, 1) = substr(x, i + 1, 1) THEN last[j - 1] + 1 ELSE last[j] END) AS steps FROM rows WHERE i < length(x)))
SELECT cell_id, last[length(y) + 1]::INT AS length FROM retyped JOIN rows ON x = original AND y = retyped AND i = length(x)"""

QUERIES = {
    f.__name__: f
    for f in (
        crowd_unpivot, crowd_accuracy, crowd_by_worker, crowd_by_accuracy, signs, crowd_busiest, crowd_pairs, char_error_rate, typo_distribution, transposition_distribution, lcs_length, lcs_align, lcs_strings,
        typo_train, transposition_train, typo_counts, error_strings, important_errors, top_of_k, single_errors, simulate_audit, simulation_report,
    )
}

SQL = {
    "crowd_unpivot": f"WITH {RETYPED}, twos AS (SELECT cell_id // 2 AS pair FROM retyped GROUP BY 1 HAVING count(*) = 2) SELECT (SELECT w.worker_id FROM retyped w WHERE w.cell_id = r.cell_id - r.cell_id % 2) AS worker_id, 'path' AS path, 'book' AS workbook, 'sheet' AS worksheet, r.cell_id::INT AS row, (r.cell_id % 2 + 1)::INT AS col, original, retyped FROM retyped r WHERE cell_id // 2 IN (SELECT pair FROM twos)",
    "crowd_accuracy": f"WITH {RETYPED} SELECT avg((original = retyped)::INT) AS accuracy, count(*) AS n_inputs, count(DISTINCT worker_id) AS n_workers FROM retyped",
    "crowd_by_worker": f"WITH {RETYPED} SELECT worker_id, count(*) AS assignments, avg((original = retyped)::INT) AS accuracy FROM retyped GROUP BY worker_id",
    "crowd_by_accuracy": f"WITH {RETYPED}, w AS (SELECT worker_id, count(*) AS assignments, avg((original = retyped)::INT) AS accuracy FROM retyped GROUP BY worker_id) SELECT *, row_number() OVER (ORDER BY accuracy DESC, worker_id)::INT AS place FROM w",
    "signs": f"WITH {CELLS} SELECT cell_id, (CASE WHEN v > 500000 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END)::INT AS sign FROM cells",
    "crowd_busiest": f"WITH {RETYPED} SELECT worker_id, count(*) AS assignments FROM retyped GROUP BY worker_id ORDER BY assignments DESC, worker_id LIMIT 1",
    "crowd_pairs": f"WITH {RETYPED} SELECT original, retyped FROM retyped",
    "char_error_rate": f"WITH {RETYPED} SELECT round(1 - sum(len(list_filter(range(1, least(length(original), length(retyped)) + 1), lambda k: substr(original, k, 1) = substr(retyped, k, 1))))::DOUBLE / sum(greatest(length(original), length(retyped)))::DOUBLE, 9) AS char_error_rate FROM retyped",
    "typo_distribution": f"WITH {TYPO} SELECT intended, typed, n, n::DOUBLE / (sum(n) OVER (PARTITION BY intended))::DOUBLE AS p FROM typo",
    "transposition_distribution": f"WITH {RETYPED}, d AS (SELECT (length(retyped) - length(original))::INT AS delta, count(*) AS n FROM retyped GROUP BY 1) SELECT delta, n, n::DOUBLE / (sum(n) OVER ())::DOUBLE AS p FROM d",
    "lcs_length": LCS_SQL,
    "important_errors": f"WITH {EFFECTS} SELECT cell_id, value, effect FROM best QUALIFY row_number() OVER (ORDER BY effect DESC, cell_id) <= ceil(0.05::DOUBLE * count(*) OVER ())",
    "top_of_k": f"WITH {EFFECTS} SELECT cell_id, value, effect FROM best",
    "single_errors": f"WITH {EFFECTS} SELECT row_number() OVER (ORDER BY md5('1:' || cell_id), cell_id, candidate)::INT AS replicate, cell_id, value FROM cands WHERE value <> raw QUALIFY row_number() OVER (ORDER BY md5('1:' || cell_id), cell_id, candidate) <= 100",
}
