"""Queries of resampling, inference and cutoffs over customers' balances in ranges of RANGE, with injected errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import NUMBER, number
from ..functions.portable import sql_draw
from ..operators import bootstrap, cutoff, inference, local
from ..sources.staging import stage_table

SEED, BOOTS, FEW, SIG = 1, 100, 20, 0.95
#: As many resamples as an interactive analysis takes; cells of a range: at most one of them is wrong.
ALL, RANGE = 2719, 60
LOW = (1 - SIG) / 2
HIGH = SIG + LOW


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in cents; every 97th is a thousand times too large."""
    wrong = F.when(F.col("c_custkey") % 97 == 0, 1000).otherwise(1)
    of = F.floor(F.col("c_custkey") / RANGE).cast("long")
    order = Window.partitionBy(of).orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(
        of.alias("range_id"), (F.row_number().over(order) - 1).alias("idx"), F.col("c_custkey").alias("cell_id"), (F.round(F.col("c_acctbal") * 100).cast("long") * wrong).alias("v"), (F.col("c_custkey") % 3 + 1).alias("weight")
    )


CELLS = f"""cells AS (SELECT c_custkey // {RANGE} AS range_id, (row_number() OVER (PARTITION BY c_custkey // {RANGE} ORDER BY c_custkey) - 1)::INT AS idx, c_custkey AS cell_id,
  round(c_acctbal * 100)::BIGINT * CASE WHEN c_custkey % 97 = 0 THEN 1000 ELSE 1 END AS v, c_custkey % 3 + 1 AS weight FROM customer)"""


def sample_sql(boots: int, source: str = "cells") -> str:
    return f"""sizes AS (SELECT range_id, count(*) AS n FROM {source} GROUP BY range_id),
boot_ids AS (SELECT b::INT AS boot_id FROM range({boots}) t(b)),
samples AS (SELECT range_id, boot_id, idx, count(*)::INT AS cnt FROM (SELECT c.range_id, boot_id, ({sql_draw(SEED, "c.range_id", "boot_id", "c.idx", "n")})::INT AS idx FROM {source} c JOIN sizes USING (range_id), boot_ids) GROUP BY ALL)"""


LEFT_OUT = "left_out AS (SELECT c.range_id, c.idx, boot_id FROM {source} c, boot_ids WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.range_id = c.range_id AND s.boot_id = boot_ids.boot_id AND s.idx = c.idx))"


def boot_resample_counts(spark, sf_dir):
    return bootstrap.resample(cells(spark, sf_dir), FEW, SEED)


def boot_excluded(spark, sf_dir):
    c = cells(spark, sf_dir)
    return bootstrap.excluded(c, bootstrap.resample(c, FEW, SEED), FEW)


def boot_histograms(spark, sf_dir):
    return bootstrap.distinct_histograms(bootstrap.resample(cells(spark, sf_dir), FEW, SEED))


def _outputs(formula: str):
    def query(spark, sf_dir):
        c = cells(spark, sf_dir)
        return bootstrap.evaluate(c, bootstrap.resample(c, BOOTS, SEED), formula)

    return query


def _outputs_sql(expr: str) -> str:
    return f"WITH {CELLS}, {sample_sql(BOOTS)} SELECT range_id, boot_id, {expr} AS value FROM samples JOIN cells USING (range_id, idx) GROUP BY range_id, boot_id"


def _mixed(spark, sf_dir) -> DataFrame:
    """Outputs as text, some of them no numbers: the first event of each type and hour, by position."""
    raw = F.when(F.col("event_id") % 401 == 0, F.lit("n/a")).when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5 "))).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("range_id"), F.col("user_id").alias("output_id"), F.col("event_id").alias("boot_id"), raw.alias("value"))


MIXED = """mixed AS (SELECT event_id % 40 AS range_id, user_id AS output_id, event_id AS boot_id,
  CASE WHEN event_id % 401 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN ' ' || event_id || '.5 ' ELSE event_id::VARCHAR END AS value FROM events)"""


def boot_numeric_check(spark, sf_dir):
    return inference.are_numeric(_mixed(spark, sf_dir))


def boot_numeric_values(spark, sf_dir):
    return _mixed(spark, sf_dir).select("boot_id", number(F.col("value")).alias("num"))


def boot_sorted(spark, sf_dir):
    c = cells(spark, sf_dir)
    boots = bootstrap.evaluate(c, bootstrap.resample(c, FEW, SEED), "SUM").withColumn("output_id", F.col("range_id"))
    return inference.ranked(boots)


def impact_numeric_scores(spark, sf_dir):
    return inference.analyze(cells(spark, sf_dir), "SUM", BOOTS, SIG, SEED)


def impact_full_scores(spark, sf_dir):
    """With as many resamples as an interactive analysis takes."""
    return inference.analyze(cells(spark, sf_dir), "SUM", ALL, SIG, SEED)


def numeric_sql(source: str = "cells", value: str = "sum(v * cnt)", whole: str = "sum(v)", boots: int = BOOTS) -> str:
    """CTEs up to ``scores``."""
    cut = lambda x: f"trunc(({x}) * 10000) / 10000.0::DOUBLE"
    return f"""{sample_sql(boots, source)},
boots AS (SELECT range_id, boot_id, ({value})::DOUBLE AS value FROM samples JOIN {source} USING (range_id, idx) GROUP BY range_id, boot_id),
{LEFT_OUT.format(source=source)},
placed AS (SELECT l.range_id, l.idx, value, row_number() OVER (PARTITION BY l.range_id, l.idx ORDER BY value, l.boot_id) - 1 AS pos, count(*) OVER (PARTITION BY l.range_id, l.idx) AS n FROM left_out l JOIN boots USING (range_id, boot_id)),
bands AS (SELECT range_id, idx, {cut(f"max(CASE WHEN pos = floor((n - 1) * {LOW!r}::DOUBLE) THEN value END)")} AS lo, {cut(f"max(CASE WHEN pos = ceil((n - 1) * {HIGH!r}::DOUBLE) THEN value END)")} AS hi, {cut("min(value)")} AS mn, {cut("max(value)")} AS mx FROM placed GROUP BY range_id, idx),
originals AS (SELECT range_id, {cut(f"({whole})::DOUBLE")} AS o FROM {source} GROUP BY range_id),
scores AS (SELECT cell_id, range_id, weight, CASE WHEN lo IS NULL THEN 0.5::DOUBLE WHEN o > hi THEN CASE WHEN mx <> hi THEN abs(o - hi) / abs(hi - mx) ELSE abs(o - hi) END
  WHEN o < lo THEN CASE WHEN mn <> lo THEN abs(o - lo) / abs(lo - mn) ELSE abs(o - lo) END ELSE 0.0::DOUBLE END AS outlierness FROM {source} JOIN originals USING (range_id) LEFT JOIN bands USING (range_id, idx))"""


def impact_average_scores(spark, sf_dir):
    """The same test on averages: a second output of the same ranges."""
    return inference.analyze(cells(spark, sf_dir), "AVERAGE", BOOTS, SIG, SEED)


def _priorities(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy(F.col("o_custkey") % 300).orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("range_id"), (F.row_number().over(order) - 1).alias("idx"), F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("v"), F.lit(1).alias("weight"))


PRIORITIES = "cells AS (SELECT o_custkey % 300 AS range_id, (row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderkey) - 1)::INT AS idx, o_orderkey AS cell_id, o_orderpriority AS v, 1 AS weight FROM orders)"


def _mode(values: DataFrame, keys: list[str]) -> DataFrame:
    counted = values.groupBy(*keys, "v").agg(F.sum("cnt").alias("c"))
    return counted.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("c").desc(), "v"))).filter("rn = 1")


def impact_string_scores(spark, sf_dir):
    c = _priorities(spark, sf_dir)
    if not local.too_large(c, FEW):
        p = F.coalesce("p", F.lit(0.0))
        return local.modes(c, FEW, SEED, True).select("cell_id", "range_id", F.col("range_id").alias("output_id"), p.alias("p"), F.when(p < 1 - SIG, F.col("weight")).otherwise(0).cast("long").alias("score"))
    samples = stage_table(bootstrap.resample(c, FEW, SEED), "samples")
    boots = _mode(samples.join(c.select("range_id", "idx", "v"), ["range_id", "idx"]), ["range_id", "boot_id"]).select("range_id", F.col("range_id").alias("output_id"), "boot_id", F.col("v").alias("value"))
    originals = _mode(c.withColumn("cnt", F.lit(1)), ["range_id"]).select("range_id", F.col("range_id").alias("output_id"), F.col("v").alias("original"))
    return inference.string_scores(c, boots, bootstrap.excluded(c, samples, FEW), originals, SIG)


STRING_SQL = f"""WITH {PRIORITIES}, {sample_sql(FEW)}, {LEFT_OUT.format(source="cells")},
counted AS (SELECT range_id, boot_id, v, sum(cnt) AS c FROM samples JOIN cells USING (range_id, idx) GROUP BY ALL),
boots AS (SELECT range_id, boot_id, v AS value FROM counted QUALIFY row_number() OVER (PARTITION BY range_id, boot_id ORDER BY c DESC, v) = 1),
whole AS (SELECT range_id, v AS original FROM (SELECT range_id, v, count(*) AS c FROM cells GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY c DESC, v) = 1),
ps AS (SELECT range_id, idx, avg(CASE WHEN value = original THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM left_out JOIN boots USING (range_id, boot_id) JOIN whole USING (range_id) GROUP BY ALL)
SELECT cell_id, range_id, range_id AS output_id, coalesce(p, 0.0::DOUBLE) AS p, (CASE WHEN coalesce(p, 0.0::DOUBLE) < {1 - SIG!r}::DOUBLE THEN weight ELSE 0 END)::BIGINT AS score FROM cells JOIN whole USING (range_id) LEFT JOIN ps USING (range_id, idx)"""


def boot_frequencies(spark, sf_dir):
    c = _priorities(spark, sf_dir)
    if not local.too_large(c, FEW):
        return inference.frequencies(local.modes(c, FEW, SEED, False).withColumn("output_id", F.col("range_id")))
    samples = bootstrap.resample(c, FEW, SEED)
    boots = _mode(samples.join(c.select("range_id", "idx", "v"), ["range_id", "idx"]), ["range_id", "boot_id"]).select("range_id", F.col("range_id").alias("output_id"), "boot_id", F.col("v").alias("value"))
    return inference.frequencies(boots)


FREQ_SQL = f"""WITH {PRIORITIES}, {sample_sql(FEW)},
counted AS (SELECT range_id, boot_id, v, sum(cnt) AS c FROM samples JOIN cells USING (range_id, idx) GROUP BY ALL),
boots AS (SELECT range_id, boot_id, v AS value FROM counted QUALIFY row_number() OVER (PARTITION BY range_id, boot_id ORDER BY c DESC, v) = 1)
SELECT range_id, range_id AS output_id, value, count(*) AS n, count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY range_id))::DOUBLE AS share FROM boots GROUP BY range_id, value"""


def _scores(spark, sf_dir) -> DataFrame:
    """Scores of two outputs of each cell's nation, merged."""
    c = cells(spark, sf_dir)
    both = {"all": ("v", "SUM"), "positive": ("positive", "SUM")}
    return inference.merge(inference.analyze_outputs(c.withColumn("positive", F.greatest(F.col("v"), F.lit(0))), both, BOOTS, SIG, SEED))


MERGED = f"""{CELLS}, first AS (WITH {numeric_sql()} SELECT cell_id, floor(weight * outlierness)::BIGINT AS score FROM scores),
second AS (WITH positive AS (SELECT range_id, idx, cell_id, greatest(v, 0) AS v, weight FROM cells), {numeric_sql("positive")} SELECT cell_id, floor(weight * outlierness)::BIGINT AS score FROM scores),
merged AS (SELECT cell_id, sum(score)::BIGINT AS score FROM (SELECT * FROM first UNION ALL SELECT * FROM second) GROUP BY cell_id)"""


def impact_weighted_merge(spark, sf_dir):
    return _scores(spark, sf_dir)


#: Cells that the user has marked as good.
def _good(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey % 291 = 0").select(F.col("c_custkey").alias("cell_id"))


GOOD = "good AS (SELECT c_custkey AS cell_id FROM customer WHERE c_custkey % 291 = 0)"


def flag_significance(spark, sf_dir):
    return cutoff.above_significance(_scores(spark, sf_dir), SIG, _good(spark, sf_dir))


FLAGGED = f"""{MERGED}, {GOOD}, ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) - 1 AS pos, count(*) OVER () AS n FROM merged),
flagged AS (SELECT cell_id, score FROM ordered WHERE score >= (SELECT score FROM ordered WHERE pos = least(n - round_even(n * {SIG!r}::DOUBLE, 0), n - 1)) AND score <> 0 AND cell_id NOT IN (SELECT cell_id FROM good))"""


def flag_first(spark, sf_dir):
    return cutoff.flag(flag_significance(spark, sf_dir))


def flag_after_ok(spark, sf_dir):
    """Marking the first flagged cell as good moves on to the next, without a new analysis."""
    scores = _scores(spark, sf_dir)
    known = cutoff.mark_ok(_good(spark, sf_dir), cutoff.flag(cutoff.above_significance(scores, SIG, _good(spark, sf_dir))))
    return cutoff.flag(cutoff.above_significance(scores, SIG, known))


def flag_after_fix(spark, sf_dir):
    """Fixing the worst cell to its true value and analysing anew."""
    c = cells(spark, sf_dir)
    # One cell is fixed at a time: its id is all that the driver needs.
    worst = cutoff.flag(inference.merge(inference.analyze(c, "SUM", BOOTS, SIG, SEED))).first()["cell_id"]
    fixes = c.filter(F.col("cell_id") == worst).select("cell_id", (F.col("v") / 1000).cast("long").alias("value"))
    return inference.merge(inference.analyze(cutoff.fix(c, fixes, "v"), "SUM", BOOTS, SIG, SEED)).filter("score > 0")


FIX_SQL = f"""WITH {CELLS}, first AS (WITH {numeric_sql()} SELECT cell_id, floor(weight * outlierness)::BIGINT AS score FROM scores),
worst AS (SELECT cell_id FROM first ORDER BY score DESC, cell_id LIMIT 1),
fixed AS (SELECT range_id, idx, cell_id, CASE WHEN cell_id IN (SELECT cell_id FROM worst) THEN trunc(v / 1000)::BIGINT ELSE v END AS v, weight FROM cells),
again AS (WITH {numeric_sql("fixed")} SELECT cell_id, floor(weight * outlierness)::BIGINT AS score FROM scores) SELECT cell_id, score FROM again WHERE score > 0"""


def scores_top10(spark, sf_dir):
    from ..sources.store import top_scores

    return top_scores(_scores(spark, sf_dir))


def cut_quantile(spark, sf_dir):
    return cutoff.quantile(_scores(spark, sf_dir), 0.10, _good(spark, sf_dir))


QUANTILE_SQL = f"""WITH {MERGED}, {GOOD}, placed AS (SELECT *, cume_dist() OVER (ORDER BY score DESC) AS upto, rank() OVER (ORDER BY score DESC) - 1 AS before, count(*) OVER () AS n FROM merged)
SELECT cell_id, score FROM placed WHERE upto < 0.1::DOUBLE + 1.0::DOUBLE / n AND before / n::DOUBLE < 0.1::DOUBLE AND cell_id NOT IN (SELECT cell_id FROM good)"""


def cut_quantile_compat(spark, sf_dir):
    """The literal walk over all cells, by regions of ties."""
    return cutoff.quantile_walk(_scores(spark, sf_dir), 0.5)


def cut_number(spark, sf_dir):
    return cutoff.number(_scores(spark, sf_dir), 12, _good(spark, sf_dir))


def cut_normal(spark, sf_dir):
    return cutoff.normal(_scores(spark, sf_dir), 0.05)


QUERIES = {
    "boot_resample_counts": boot_resample_counts,
    "boot_excluded": boot_excluded,
    "boot_histograms": boot_histograms,
    "boot_outputs_sum": _outputs("SUM"),
    "boot_outputs_avg": _outputs("AVERAGE"),
    "boot_outputs_median": _outputs("MEDIAN"),
    "boot_outputs_count": _outputs("COUNT"),
    "boot_outputs_min": _outputs("MIN"),
    "boot_outputs_max": _outputs("MAX"),
    "boot_numeric_check": boot_numeric_check,
    "boot_numeric_values": boot_numeric_values,
    "boot_sorted": boot_sorted,
    "boot_frequencies": boot_frequencies,
    "impact_numeric_scores": impact_numeric_scores,
    "impact_full_scores": impact_full_scores,
    "impact_average_scores": impact_average_scores,
    "impact_string_scores": impact_string_scores,
    "impact_weighted_merge": impact_weighted_merge,
    "flag_significance": flag_significance,
    "flag_first": flag_first,
    "flag_after_ok": flag_after_ok,
    "flag_after_fix": flag_after_fix,
    "scores_top10": scores_top10,
    "cut_quantile": cut_quantile,
    "cut_quantile_compat": cut_quantile_compat,
    "cut_number": cut_number,
    "cut_normal": cut_normal,
}

#: The literal walk as a loop: start and end are places in the ordered list; a region's rest from start on is taken.
COMPAT_SQL = f"""WITH RECURSIVE {MERGED}, ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) - 1 AS pos, count(*) OVER () AS n FROM merged),
ends AS (SELECT pos, cell_id, score, n, (SELECT count(*) FROM merged m WHERE m.score >= o.score) AS upto FROM ordered o),
walk AS (SELECT 0::BIGINT AS start, 0::BIGINT AS upto, 0::BIGINT AS last, false AS done
  UNION ALL SELECT greatest(w.start, x.region) + 1, x.region, w.start, x.region / e.n::DOUBLE >= 0.5::DOUBLE + 1.0::DOUBLE / e.n
  FROM walk w JOIN ends e ON e.pos = w.start, LATERAL (SELECT CASE WHEN w.upto < e.n AND (SELECT score FROM ends f WHERE f.pos = w.upto) = e.score THEN (SELECT f.upto FROM ends f WHERE f.pos = w.upto) ELSE w.upto END AS region) x
  WHERE NOT w.done AND w.start / e.n::DOUBLE < 0.5::DOUBLE)
SELECT cell_id, score FROM ends e WHERE EXISTS (SELECT 1 FROM walk w WHERE NOT done AND upto > 0 AND e.pos >= w.last AND e.pos < w.upto)"""

SQL = {
    "cut_quantile_compat": COMPAT_SQL,
    "boot_resample_counts": f"WITH {CELLS}, {sample_sql(FEW)} SELECT * FROM samples",
    "boot_excluded": f"WITH {CELLS}, {sample_sql(FEW)}, {LEFT_OUT.format(source='cells')} SELECT * FROM left_out",
    "boot_histograms": f"WITH {CELLS}, {sample_sql(FEW)}, h AS (SELECT range_id, boot_id, string_agg(idx || 'x' || cnt, ' ' ORDER BY idx) AS histogram FROM samples GROUP BY ALL) SELECT range_id, histogram, min(boot_id)::INT AS boot_id, count(*) AS n_equal FROM h GROUP BY ALL",
    "boot_outputs_sum": _outputs_sql("sum(v * cnt)::BIGINT"),
    "boot_outputs_avg": _outputs_sql("sum(v * cnt)::DOUBLE / sum(cnt)::DOUBLE"),
    "boot_outputs_count": _outputs_sql("sum(cnt)::BIGINT"),
    "boot_outputs_min": _outputs_sql("min(v)"),
    "boot_outputs_max": _outputs_sql("max(v)"),
    "boot_outputs_median": f"WITH {CELLS}, {sample_sql(BOOTS)}, flat AS (SELECT range_id, boot_id, v, unnest(range(cnt)) FROM samples JOIN cells USING (range_id, idx)) SELECT range_id, boot_id, quantile_cont(v::DOUBLE, 0.5) AS value FROM flat GROUP BY range_id, boot_id",
    "boot_numeric_check": f"WITH {MIXED} SELECT range_id, output_id, bool_and(regexp_matches(trim(value), '{NUMBER}')) AS numeric FROM mixed GROUP BY ALL",
    "boot_numeric_values": f"WITH {MIXED} SELECT boot_id, CASE WHEN regexp_matches(trim(value), '{NUMBER}') THEN try_cast(trim(value) AS DOUBLE) END AS num FROM mixed",
    "boot_sorted": f"WITH {CELLS}, {sample_sql(FEW)}, b AS (SELECT range_id, boot_id, sum(v * cnt)::BIGINT AS value FROM samples JOIN cells USING (range_id, idx) GROUP BY ALL) SELECT range_id, boot_id, value, range_id AS output_id, (row_number() OVER (PARTITION BY range_id ORDER BY value, boot_id) - 1)::INT AS pos FROM b",
    "boot_frequencies": FREQ_SQL,
    "impact_numeric_scores": f"WITH {CELLS}, {numeric_sql()} SELECT cell_id, range_id, range_id AS output_id, outlierness, floor(weight * outlierness)::BIGINT AS score FROM scores",
    "impact_full_scores": f"WITH {CELLS}, {numeric_sql(boots=ALL)} SELECT cell_id, range_id, range_id AS output_id, outlierness, floor(weight * outlierness)::BIGINT AS score FROM scores",
    "impact_average_scores": f"WITH {CELLS}, {numeric_sql(value='sum(v * cnt)::DOUBLE / sum(cnt)::DOUBLE', whole='sum(v)::DOUBLE / count(*)::DOUBLE')} SELECT cell_id, range_id, range_id AS output_id, outlierness, floor(weight * outlierness)::BIGINT AS score FROM scores",
    "impact_string_scores": STRING_SQL,
    "impact_weighted_merge": f"WITH {MERGED} SELECT * FROM merged",
    "flag_significance": f"WITH {FLAGGED} SELECT * FROM flagged",
    "flag_first": f"WITH {FLAGGED} SELECT * FROM flagged ORDER BY score DESC, cell_id LIMIT 1",
    "flag_after_ok": f"WITH {FLAGGED} SELECT * FROM flagged ORDER BY score DESC, cell_id LIMIT 1 OFFSET 1",
    "flag_after_fix": FIX_SQL,
    "scores_top10": f"WITH {MERGED} SELECT * FROM merged ORDER BY score DESC, cell_id LIMIT 10",
    "cut_quantile": QUANTILE_SQL,
    "cut_number": f"WITH {MERGED}, {GOOD} SELECT * FROM (SELECT * FROM merged ORDER BY score DESC, cell_id LIMIT 12) WHERE cell_id NOT IN (SELECT cell_id FROM good)",
    "cut_normal": f"WITH {MERGED} SELECT cell_id, score FROM merged WHERE score > (SELECT avg(score) + 1.6448::DOUBLE * stddev_pop(score) FROM merged)",
}
