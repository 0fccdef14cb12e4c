"""Queries of normal baselines, error metrics and mistakes over line items, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mistakes
from ..functions.numbers import ERF_A, ERF_P, NUMBER, erf, erfc, phi
from ..operators import metrics, normal
from .impact import table


def _prices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("range_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cell_id"), F.round(F.col("l_extendedprice") * F.when((F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 499 == 0, 1000).otherwise(100)).alias("v"))


PRICES = "prices AS (SELECT l_suppkey AS range_id, l_orderkey * 8 + l_linenumber AS cell_id, round(l_extendedprice * CASE WHEN (l_orderkey * 8 + l_linenumber) % 499 = 0 THEN 1000 ELSE 100 END) AS v FROM lineitem)"


def normal_summary(spark, sf_dir):
    s = normal.summary(_prices(spark, sf_dir))
    return s.select("range_id", "n", F.round("mean", 3).alias("mean"), F.round(F.col("variance") / 1e6, 3).alias("variance"), F.round("sd", 3).alias("sd"))


def normal_per_range(spark, sf_dir):
    return normal.outliers(_prices(spark, sf_dir)).withColumn("z", F.round("z", 6)).drop("v")


def normal_all_inputs(spark, sf_dir):
    return normal.outliers(_prices(spark, sf_dir), False).withColumn("z", F.round("z", 6)).drop("v")


def _seen(spark, sf_dir) -> DataFrame:
    return _prices(spark, sf_dir).filter("cell_id % 5 = 0").select("cell_id")


def normal_step_per_range(spark, sf_dir):
    return normal.step_per_range(_prices(spark, sf_dir), _seen(spark, sf_dir)).withColumn("z", F.round("z", 6))


def normal_step_all(spark, sf_dir):
    return normal.step_all(_prices(spark, sf_dir), _seen(spark, sf_dir)).withColumn("z", F.round("z", 6))


def _outliers_sql(over: str) -> str:
    part = "PARTITION BY range_id" if over else ""
    return f"""{PRICES}, z AS (SELECT range_id, cell_id, abs(v - avg(v) OVER ({part})) / nullif(stddev_pop(v) OVER ({part}), 0) AS z FROM prices),
far AS (SELECT range_id, cell_id, z, row_number() OVER ({part} ORDER BY z DESC, cell_id)::INT AS rank FROM z WHERE z > 2.0)"""


def erf_phi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    return e.crossJoin(F.broadcast(facts)).select("event_id", F.round(erf(z), 6).alias("erf"), F.round(erfc(z), 6).alias("erfc"), F.round(phi(z), 6).alias("phi"))


def _erf_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * abs({x})))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}::DOUBLE) * {t})"
    return f"(sign({x}) * (1.0::DOUBLE - {poly} * exp(-({x}) * ({x}))))"


ERF_SQL = f"""WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), z AS (SELECT event_id, (value - m) / s AS z FROM events, f)
SELECT event_id, round({_erf_sql("z")}, 6) AS erf, round(1.0::DOUBLE - {_erf_sql("z")}, 6) AS erfc, round(0.5::DOUBLE * (1.0::DOUBLE + {_erf_sql("(z / sqrt(2.0::DOUBLE))")}), 6) AS phi FROM z"""


# Errors: prices of orders as text; every 11th gets its point moved, every 23rd turns into text, every 31st is blanked.
def _correct(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"))


def _errors(spark, sf_dir) -> DataFrame:
    c = _correct(spark, sf_dir)
    k = F.col("cell_id")
    bad = F.when(k % 31 == 0, F.lit(" ")).when(k % 23 == 0, F.concat(F.lit("x"), F.col("value"))).when(k % 11 == 0, F.concat(F.col("value"), F.lit("0")))
    return c.select("cell_id", bad.alias("value")).filter(F.col("value").isNotNull())


VALUES = f"""correct AS (SELECT o_orderkey AS cell_id, (round(o_totalprice * 100)::BIGINT)::VARCHAR AS value FROM orders),
errs AS (SELECT cell_id, CASE WHEN cell_id % 31 = 0 THEN ' ' WHEN cell_id % 23 = 0 THEN 'x' || value ELSE value || '0' END AS value FROM correct WHERE cell_id % 31 = 0 OR cell_id % 23 = 0 OR cell_id % 11 = 0),
incorrect AS (SELECT c.cell_id, CASE WHEN e.value IS NOT NULL AND c.cell_id % 2 = 1 THEN e.value ELSE c.value END AS value FROM correct c LEFT JOIN errs e USING (cell_id)),
paired AS (SELECT cell_id, c.value AS c, i.value AS e, regexp_matches(trim(c.value), '{NUMBER}') AND regexp_matches(trim(i.value), '{NUMBER}') AS nums, try_cast(trim(c.value) AS DOUBLE) AS cn, try_cast(trim(i.value) AS DOUBLE) AS en
  FROM correct c JOIN incorrect i USING (cell_id)),
errored AS (SELECT *, CASE WHEN nums THEN abs(cn - en) WHEN c = e THEN 0.0 ELSE 1.0 END AS err FROM paired)"""


def _cells(spark, sf_dir) -> DataFrame:
    """Even orders count as formulas, which injection leaves alone."""
    return _correct(spark, sf_dir).select("cell_id", F.col("value").alias("raw"), (F.col("cell_id") % 2 == 0).alias("is_formula"))


def _incorrect(spark, sf_dir) -> DataFrame:
    return metrics.inject(_cells(spark, sf_dir), _errors(spark, sf_dir)).select("cell_id", F.col("raw").alias("value"))


def inject_values(spark, sf_dir):
    return _incorrect(spark, sf_dir)


def max_errors(spark, sf_dir):
    return metrics.max_errors(_correct(spark, sf_dir), _incorrect(spark, sf_dir))


def total_error(spark, sf_dir):
    return metrics.total_error(_correct(spark, sf_dir), _incorrect(spark, sf_dir)).select(F.round("total_error", 0).alias("total_error"))


def _normalized(spark, sf_dir) -> DataFrame:
    most = metrics.max_errors(_correct(spark, sf_dir), _incorrect(spark, sf_dir)).withColumn("err", F.col("err") * 2)
    return metrics.normalized_error(_correct(spark, sf_dir), _incorrect(spark, sf_dir), most)


def normalized_error(spark, sf_dir):
    return _normalized(spark, sf_dir)


def total_relative_error(spark, sf_dir):
    return metrics.total_relative_error(_normalized(spark, sf_dir)).select(F.round("total_relative_error", 9).alias("total_relative_error"))


def error_magnitude(spark, sf_dir):
    return metrics.magnitudes(_correct(spark, sf_dir), _incorrect(spark, sf_dir)).withColumn("num_magnitude", F.round("num_magnitude", 6))


def mean_error_magnitude(spark, sf_dir):
    return metrics.mean_magnitude(_correct(spark, sf_dir), _incorrect(spark, sf_dir)).select(F.round("mean_magnitude", 9).alias("mean_magnitude"))


def _inspected(spark, sf_dir) -> DataFrame:
    """A made-up inspection: orders divisible by 7, largest first; those with an error are true positives."""
    picked = _correct(spark, sf_dir).filter("cell_id % 7 = 0")
    wrong = _errors(spark, sf_dir).select("cell_id", F.lit(True).alias("is_error"))
    return picked.join(wrong, "cell_id", "left").select("cell_id", F.coalesce("is_error", F.lit(False)).alias("is_error")).withColumn("k", F.row_number().over(Window.orderBy(F.col("cell_id").desc())))


INSPECTED = f"{VALUES}, inspected AS (SELECT cell_id, cell_id IN (SELECT cell_id FROM errs) AS is_error, row_number() OVER (ORDER BY cell_id DESC) AS k FROM correct WHERE cell_id % 7 = 0)"


def false_negatives(spark, sf_dir):
    i = _inspected(spark, sf_dir)
    return metrics.false_negatives(_errors(spark, sf_dir), i.filter("is_error"), i.filter("NOT is_error"))


def precision_terms(spark, sf_dir):
    return metrics.precision_terms(_inspected(spark, sf_dir)).select("k", F.round("term", 9).alias("term"))


def average_precision(spark, sf_dir):
    return metrics.average_precision(_inspected(spark, sf_dir), _errors(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


TERMS = f"{INSPECTED}, terms AS (SELECT k, CASE WHEN is_error THEN sum(is_error::INT) OVER (ORDER BY k)::DOUBLE / k::DOUBLE ELSE 0.0::DOUBLE END AS term FROM inspected)"


def _mistaken(spark, sf_dir) -> DataFrame:
    """Prices with a typical mistake each, by the key's remainder."""
    o = F.concat(F.when(F.col("p_partkey") % 2 == 0, "-").otherwise(""), F.format_string("%.2f", F.col("p_retailprice")))
    n = F.char_length("o")
    change = {
        0: F.concat(F.substring(F.replace(F.col("o"), F.lit("."), F.lit("")), F.lit(1), n - 2), F.lit("."), F.substring(F.col("o"), n, F.lit(1))),
        1: F.replace(F.col("o"), F.lit("."), F.lit("")),
        2: F.replace(F.col("o"), F.lit("-"), F.lit("")),
        3: F.when(F.col("o").startswith("-"), F.substring(F.col("o"), F.lit(2), n)).otherwise(F.concat(F.lit("-"), F.col("o"))),
        4: F.concat(F.col("o"), F.substring(F.col("o"), n, F.lit(1))),
        5: F.concat(F.lit("7"), F.col("o")),
        6: F.concat(F.substring(F.col("o"), F.lit(1), n - 1), F.lit("5")),
        7: F.substring(F.col("o"), F.lit(1), n - 1),
        8: F.lit(""),
        9: F.concat(F.substring(F.col("o"), F.lit(1), n - 2), F.substring(F.col("o"), n, F.lit(1)), F.substring(F.col("o"), n - 1, F.lit(1))),
    }
    e = F.coalesce(*[F.when(F.col("p_partkey") % 10 == k, v) for k, v in change.items()])
    return table(spark, sf_dir, "part").select("p_partkey", o.alias("o")).withColumn("e", e)


def mistake_classes(spark, sf_dir):
    """Which predicates hold for each pair."""
    o, e = F.col("o"), F.col("e")
    return _mistaken(spark, sf_dir).select("p_partkey", "o", "e", *[F.coalesce(f(o, e), F.lit(False)).alias(name) for name, f in mistakes.ALL.items()])


_D = "regexp_replace({}, '[^0-9]', '', 'g')"
_CUTS = "list_contains(list_transform(range(1, length({a}) + 1), lambda k: substr({a}, 1, k - 1) || substr({a}, k + 1)), {b}) AND length({a}) = length({b}) + 1"
MISTAKES_SQL = f"""WITH base AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END || format('{{:.2f}}', p_retailprice) AS o FROM part),
pairs AS (SELECT p_partkey, o, CASE p_partkey % 10 WHEN 0 THEN substr(replace(o, '.', ''), 1, length(o) - 2) || '.' || substr(o, length(o), 1) WHEN 1 THEN replace(o, '.', '') WHEN 2 THEN replace(o, '-', '')
  WHEN 3 THEN CASE WHEN starts_with(o, '-') THEN substr(o, 2) ELSE '-' || o END WHEN 4 THEN o || substr(o, length(o), 1) WHEN 5 THEN '7' || o WHEN 6 THEN substr(o, 1, length(o) - 1) || '5'
  WHEN 7 THEN substr(o, 1, length(o) - 1) WHEN 8 THEN '' ELSE substr(o, 1, length(o) - 2) || substr(o, length(o), 1) || substr(o, length(o) - 1, 1) END AS e FROM base),
tested AS (SELECT *, coalesce(regexp_matches(trim(o), '{NUMBER}') AND regexp_matches(trim(e), '{NUMBER}'), false) AS nums FROM pairs),
named AS (SELECT p_partkey, o, e, nums,
  nums AND instr(o, '.') > 0 AND replace(o, '.', '') = e AS decimal_omission,
  nums AND regexp_matches(o, '^[+-]') AND substr(o, 2) = e AS sign_omission FROM tested)
SELECT p_partkey, o, e,
  nums AND {_D.format("o")} = {_D.format("e")} AND instr(o, '.') <> instr(e, '.') AND instr(o, '.') > 0 AND instr(e, '.') > 0 AS misplaced_decimal, decimal_omission, sign_omission,
  nums AND coalesce(try_cast(o AS DOUBLE) = -try_cast(e AS DOUBLE) AND try_cast(o AS DOUBLE) <> 0, false) AS sign_error,
  nums AND list_contains(list_transform(range(1, length(o) + 1), lambda k: substr(o, 1, k) || substr(o, k)), e) AS digit_repeat,
  nums AND {_CUTS.format(a="e", b="o")} AS extra_digit,
  nums AND length(o) = length(e) AND len(list_filter(range(1, length(o) + 1), lambda k: substr(o, k, 1) <> substr(e, k, 1))) = 1 AS wrong_digit,
  nums AND {_CUTS.format(a="o", b="e")} AND NOT decimal_omission AND NOT sign_omission AS digit_omission,
  trim(o) <> '' AND trim(e) = '' AS blank,
  nums AND length(o) = length(e) AND o <> e AND list_contains(list_transform(range(1, length(o)), lambda k: substr(o, 1, k - 1) || substr(o, k + 1, 1) || substr(o, k, 1) || substr(o, k + 2)), e) AS digit_transposition
FROM named"""

QUERIES = {f.__name__: f for f in (normal_summary, normal_per_range, normal_all_inputs, normal_step_per_range, normal_step_all, erf_phi, inject_values, max_errors, total_error, normalized_error, total_relative_error, error_magnitude, mean_error_magnitude, false_negatives, precision_terms, average_precision, mistake_classes)}

SQL = {
    "normal_summary": f"WITH {PRICES} SELECT range_id, count(*) AS n, round(avg(v), 3) AS mean, round(var_pop(v) / 1e6, 3) AS variance, round(stddev_pop(v), 3) AS sd FROM prices GROUP BY range_id",
    "normal_per_range": f"WITH {_outliers_sql('r')} SELECT range_id, cell_id, round(z, 6) AS z, rank FROM far",
    "normal_all_inputs": f"WITH {_outliers_sql('')} SELECT range_id, cell_id, round(z, 6) AS z, rank FROM far",
    "normal_step_per_range": f"WITH {_outliers_sql('r')} SELECT cell_id, range_id, round(z, 6) AS z FROM far WHERE cell_id % 5 <> 0 ORDER BY range_id, rank LIMIT 1",
    "normal_step_all": f"WITH {_outliers_sql('')} SELECT cell_id, range_id, round(z, 6) AS z FROM far WHERE cell_id % 5 <> 0 ORDER BY rank LIMIT 1",
    "erf_phi": ERF_SQL,
    "inject_values": f"WITH {VALUES} SELECT * FROM incorrect",
    "max_errors": f"WITH {VALUES} SELECT cell_id, err::DOUBLE AS err FROM errored",
    "total_error": f"WITH {VALUES} SELECT round(sum(err), 0)::DOUBLE AS total_error FROM errored",
    "normalized_error": f"WITH {VALUES} SELECT cell_id, (CASE WHEN nums THEN CASE WHEN err = 0 THEN 0.0 ELSE abs(en - cn) / (2 * err) END WHEN c = e THEN 0.0 ELSE 1.0 END)::DOUBLE AS err FROM errored",
    "total_relative_error": f"WITH {VALUES} SELECT round(avg((CASE WHEN nums THEN CASE WHEN err = 0 THEN 0.0 ELSE abs(en - cn) / (2 * err) END WHEN c = e THEN 0.0 ELSE 1.0 END)::DOUBLE), 9) AS total_relative_error FROM errored",
    "error_magnitude": f"WITH {VALUES} SELECT cell_id, round((CASE WHEN nums AND cn <> en THEN log10(abs(en - cn) / abs(cn + 1e-12)) ELSE 0.0 END)::DOUBLE, 6) AS num_magnitude, (CASE WHEN nums OR c = e THEN 0.0 ELSE 1.0 END)::DOUBLE AS str_magnitude FROM paired",
    "mean_error_magnitude": f"WITH {VALUES}, x AS (SELECT cn, CASE WHEN trim(e) = '' THEN 0.0 WHEN regexp_matches(trim(e), '{NUMBER}') THEN en END AS en FROM paired) SELECT round(avg(abs(en - cn) / abs(cn)), 9) AS mean_magnitude FROM x WHERE cn <> 0",
    "false_negatives": f"WITH {INSPECTED} SELECT cell_id FROM errs WHERE cell_id NOT IN (SELECT cell_id FROM inspected)",
    "precision_terms": f"WITH {TERMS} SELECT k::INT AS k, round(term, 9) AS term FROM terms",
    "average_precision": f"WITH {TERMS} SELECT round((SELECT sum(term) FROM terms) / (SELECT count(*) FROM errs), 9) AS average_precision",
    "mistake_classes": MISTAKES_SQL,
}
