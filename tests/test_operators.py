"""Small hand-computed cases, sources and sinks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from suspectra.functions import numbers
from suspectra.operators import crowd, cutoff, graph, inference, normal, simulate, typo_model
from suspectra.plans import formula
from suspectra.sources import store


def outlier(spark, original, low, high, least, most):
    row = spark.range(1).select(inference.outlierness(*[F.lit(float(x)) for x in (original, low, high, least, most)]).alias("o"))
    return row.first()["o"]


def test_outlierness_branches(spark):
    assert outlier(spark, 5, 0, 10, -5, 20) == 0.0
    assert outlier(spark, 15, 0, 10, -5, 20) == 0.5
    assert outlier(spark, 15, 0, 10, -5, 10) == 5.0
    assert outlier(spark, -10, 0, 10, -5, 20) == 2.0
    assert outlier(spark, -3, 0, 10, 0, 20) == 3.0
    assert outlier(spark, 10.00009, 0, 10, -5, 20) == 0.0


def test_without_exclusions(spark):
    cells = spark.createDataFrame([(1, 0, 7, 4)], "range_id int, idx int, cell_id long, weight int")
    boots = spark.createDataFrame([(1, 1, 0, 3.0)], "range_id int, output_id int, boot_id int, value double")
    none = spark.createDataFrame([], "range_id int, idx int, boot_id int")
    numeric = inference.numeric_scores(cells, boots, none, spark.createDataFrame([(1, 1, 3.0)], "range_id int, output_id int, original double")).first()
    assert (numeric["outlierness"], numeric["score"]) == (0.5, 2)
    text = inference.string_scores(cells, boots.withColumn("value", F.lit("x")), none, spark.createDataFrame([(1, 1, "x")], "range_id int, output_id int, original string")).first()
    assert (text["p"], text["score"]) == (0.0, 4)


def walk(scores, share):
    """Whole regions of ties, taken while they start before the share and end within it."""
    n, out, start = len(scores), [], 0
    while start < n and start / n < share:
        end = start
        while end < n and scores[end][1] == scores[start][1]:
            end += 1
        if end / n >= share + 1 / n:
            break
        out += scores[start:end]
        start = end
    return out


def test_quantile(spark):
    rng, different = random.Random(2), 0
    for _ in range(12):
        scores = sorted(((k, rng.choice([0, 0, 1, 2, 3, 9])) for k in range(rng.randint(1, 25))), key=lambda x: (-x[1], x[0]))
        share = rng.choice([0.1, 0.3, 0.5])
        got = cutoff.quantile(spark.createDataFrame(scores, "cell_id long, score long"), share).collect()
        assert sorted((r[0], r[1]) for r in got) == sorted(walk(scores, share))
        different += cutoff.quantile_compat(scores, share) != walk(scores, share)
    assert different
    assert cutoff.quantile_compat([(0, 9), (1, 5), (2, 5), (3, 1)], 0.75) == [(0, 9), (2, 5)]


def test_cutoff_checks(spark):
    assert abs(cutoff.significance_of("5.0") - 0.95) < 1e-12
    for bad in ("0", "100", "250", "-1"):
        with pytest.raises(ValueError, match="per cent"):
            cutoff.significance_of(bad)
    with pytest.raises(ValueError, match="quantile"):
        cutoff.normal(spark.createDataFrame([(1, 1)], "cell_id long, score long"), 0.2)
    scores = spark.createDataFrame([(k, k) for k in range(20)], "cell_id long, score long")
    assert [r["cell_id"] for r in cutoff.Cutoff("significance", 0.95).apply(scores).orderBy("cell_id").collect()] == [18, 19]
    assert cutoff.Cutoff("significance", 0.001).apply(scores).count() >= 0
    good = spark.createDataFrame([(19,)], "cell_id long")
    assert cutoff.Cutoff("number", 1).apply(scores, good).count() == 0 and cutoff.Cutoff("number", 1).is_count_based


def test_numbers(spark):
    rows = [("12",), (" 1.5 ",), ("-.5",), ("1e3",), ("1d",), ("NaN",), ("Infinity",), ("1,234",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(numbers.number(F.col("x"))).collect()]
    assert got == [12.0, 1.5, -0.5, 1000.0, None, None, None, None, None, None]
    cut = [r[0] for r in spark.createDataFrame([(1.99999,), (-1.99999,)], "x double").select(numbers.cut4(F.col("x"))).collect()]
    assert cut == [1.9999, -1.9999]


def test_formulas(spark):
    rows = [(1, "S", "=A1"), (2, "S", "=A1:B3"), (3, "S", "=SUM(A1:B3)+AVERAGE(C2:C8)"), (4, "S", "='My sheet'!$B$2*Other!C3:C4+LOG10(D4)"), (5, "S", "=AB12+ZZ9")]
    f = spark.createDataFrame(rows, "formula_id int, worksheet string, expr string")
    n = {r["formula_id"]: r["count"] for r in formula.ranges(f).groupBy("formula_id").count().collect()}
    assert n == {2: 1, 3: 2, 4: 1}
    singles = {tuple(r) for r in formula.singles(f).collect()}
    assert singles == {(1, "S", 1, 1), (4, "My sheet", 2, 2), (4, "S", 4, 4), (5, "S", 12, 28), (5, "S", 9, 702)}
    assert {tuple(r) for r in formula.ranges(f).filter("formula_id = 4").collect()} == {(4, "Other", 3, 3, 4, 3)}


def test_placed_formulas_are_found(spark):
    cells = store.cells_from_wide(spark.createDataFrame([(k, f"=SUM(A1:A{k})" if k > 2 else "x") for k in range(1, 6)], "a int, b string"), order=["a"])
    g = graph.build(cells)
    assert g.formulas.count() == 3 and g.vectors.filter("perturbable").count() == 3
    assert graph.terminal_formulas(g).count() == graph.terminal_formulas(g, True).count() == 3
    assert not graph.contains_loop(g)
    loop = store.cells_from_wide(spark.createDataFrame([("=B1", "=A1")], "a string, b string"))
    assert graph.contains_loop(graph.build(loop))


def test_normal_steps(spark):
    cells = spark.createDataFrame([(1, k, 10.0) for k in range(20)] + [(1, 99, 1000.0), (2, 200, 1.0), (2, 201, None)], "range_id int, cell_id long, v double")
    none = spark.createDataFrame([], "cell_id long")
    assert normal.step_per_range(cells, none).first()["cell_id"] == 99
    assert normal.step_per_range(cells, spark.createDataFrame([(99,)], "cell_id long")).first() is None
    assert normal.step_all(cells, none).first()["cell_id"] == 99


def test_typo_model_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("Testing", "Tesying"), ("Testing", "Testing"), ("acc", "cca"), (None, "x")], "original string, retyped string")
    typo, moves = typo_model.train(pairs)
    store.write_model(typo, moves, str(tmp_path / "model"))
    again = store.read_model(spark, str(tmp_path / "model"))
    assert again[0].count() == typo.count() and {tuple(r) for r in again[1].collect()} == {tuple(r) for r in moves.collect()}
    model = typo_model.load(*again)
    assert model.moves[2] == 1 and model.typos[("T", "T")] == 2
    total = typo_model.typo_distribution(typo).groupBy("intended").agg(F.round(F.sum("p"), 9).alias("s")).collect()
    assert all(r["s"] == 1.0 for r in total)


def test_errors_and_results(spark, tmp_path):
    errors = spark.createDataFrame([(1, 2, "p", "b", "s", "12<3"), (3, 4, "p", "b", "s", "x & y")], store.ERRORS)
    store.write_errors(errors, str(tmp_path / "errors"))
    assert sorted(map(tuple, store.read_errors(spark, str(tmp_path / "errors")).collect())) == sorted(map(tuple, errors.collect()))
    log = spark.createDataFrame([("f", "bootstrap", 0.95, 0.1, "1", "2", "3", 0.5, 0.1, 0.0, True, False)], store.ITERATIONS)
    for _ in range(2):
        store.append_csv(log, str(tmp_path / "log"), store.ITERATIONS)
    assert [tuple(r) for r in store.read_csv(spark, str(tmp_path / "log"), store.ITERATIONS).collect()] == [tuple(log.first())] * 2
    store.write_timeseries(spark.createDataFrame([("b", 1.0, 2)], "workbook string, error double, effort int"), str(tmp_path / "series"))


def test_crowd_csv(spark, tmp_path):
    width = crowd.ITEMS_AT + 2 * 8
    row = ["h"] * crowd.ITEMS_AT + ["p", "b", "s", "1", "2", "orig, 1", "u", "p", "b", "s", "3", "4", "orig2", "u", "orig, 1", "typed"]
    row[crowd.WORKER_AT] = "w1"
    lines = [",".join(f"c{k}" for k in range(width)), ",".join(f'"{x}"' for x in row)]
    (tmp_path / "crowd.csv").write_text("\n".join(lines))
    got = sorted(map(tuple, crowd.unpivot(store.read_crowd_csv(spark, str(tmp_path / "crowd.csv"))).collect()))
    assert got == [("w1", "p", "b", "s", 1, 2, "orig, 1", "orig, 1"), ("w1", "p", "b", "s", 3, 4, "orig2", "typed")]
    assert crowd.items_per_row(width) == 2


def test_dot_file(spark, tmp_path):
    cells = store.cells_from_wide(spark.createDataFrame([("1", "=A1")], "a string, b string"))
    store.write_dot(graph.dot(graph.build(cells)), str(tmp_path / "dot"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "dot")).collect()][0] == "digraph dependencies {"


def test_simulation_needs_ranges(spark):
    with pytest.raises(ValueError, match="range"):
        simulate.checked(spark.createDataFrame([(1, 0, 1, 1.0, 1)], "range_id int, idx int, cell_id long, v double, weight int"))


def test_follow_fixes(spark, tmp_path):
    from suspectra.streaming.reanalysis import follow_fixes

    cells = spark.createDataFrame([(1, k, k, 1000 if k == 3 else 10, 1) for k in range(12)], "range_id int, idx int, cell_id long, v long, weight int")
    cells.write.parquet(str(tmp_path / "cells/start"))
    spark.createDataFrame([(3, 10)], "cell_id long, v long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell_id long, v long").parquet(str(tmp_path / "in"))
    q = follow_fixes(stream, str(tmp_path / "cells"), str(tmp_path / "scores"), str(tmp_path / "ck"), 20)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "scores/0")).agg(F.max("score")).first()[0] == 0


def test_entry_without_corpus_operators(tmp_path):
    """Everything else imports when both folders of the corpus operators are deleted, with their pipeline or without it."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_numeric_scores' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    for k, gone in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        shutil.copytree(here, tmp_path / f"r{k}", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
        assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / f"r{k}", env=os.environ | {"PYTHONPATH": ""}, check=False).returncode == 0


def test_experiments(spark, tmp_path):
    from suspectra.__main__ import main
    from suspectra.functions.errors import ErrorModel
    from suspectra.operators import experiments

    cells = spark.createDataFrame([(k % 2, k // 2, k, 100 + k, 1) for k in range(24)], "range_id int, idx int, cell_id long, v long, weight int")
    model = ErrorModel({(str(d), str(d)): 3 for d in range(10)} | {(str(d), f"{d}00"): 1 for d in range(10)}, {0: 9, 1: 1})
    got = experiments.important(cells, model, 2, boots=20, rounds=2, detectors=experiments.DETECTORS[1:]).first()
    assert got["number_of_errors"] == 2 and got["effort"] <= 2
    one = experiments.proportion(cells, model, 2, boots=20, rounds=1, detectors=experiments.DETECTORS[1:]).collect()
    assert [r["replicate"] for r in one] == [1, 2] and all(r["number_of_errors"] == 1 for r in one)
    assert experiments.candidates(cells, model, 1, subtle=True).count() == 24
    cells.write.parquet(str(tmp_path / "cells"))
    main(["analyze", str(tmp_path / "cells"), str(tmp_path / "scores"), "--boots", "20"])
    assert spark.read.parquet(str(tmp_path / "scores")).columns == ["cell_id", "score"]
