"""Formulas, workbooks and audits: hand-computed cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from suspectra.functions import align, expression, numbers
from suspectra.operators import cutoff, evaluate, experiments, graph, inference, simulate, typo_model
from suspectra.sources import store
from suspectra.streaming.reanalysis import last_fixes


def value(text: str, **cells):
    """A formula's value; aggregates over single cells only."""
    nodes, done = expression.parse(text, "S"), []
    for n in nodes:
        args = [done[p] if kind == "node" else p if kind == "const" else cells.get(f"{chr(64 + p[2])}{p[1]}") for kind, p in n.members]
        done.append(expression.calculate(n.program, args) if n.func == "CALC" else float(sum(args)))
    return done[-1]


def test_formulas():
    assert value("=1+2*3") == 7 and value("=-2^2") == 4 and value("=2^3^2") == 64 and value("=(1+2)*3%") == 0.09
    assert value('=IF(A1=0,"none",1/A1)', A1=0.0) == "none" and value('=IF(A1=0,"none",1/A1)', A1=4.0) == 0.25
    assert value('=A1&"x"&B1', A1=1.5, B1="q") == "1.5xq" and value('="a"<"B"') == 1 and value('=10<"a"') == 1
    assert value("=ROUND(2.5,0)+MOD(-1,3)") == 5 and value("=A1+1") == 1 and value("=A1+1", A1="7") == 8
    assert value("=SUM(A1,2*B1,3)*2", A1=1.0, B1=4.0) == 24
    assert value("=A1/0") == "#DIV/0!" and value("=FOO(1)") == "#NAME?" and value("=1+") == "#VALUE!" and value("=A1+1", A1="x") == "#VALUE!"
    assert value("=A1+1", A1="#N/A") == "#N/A" and value("=SQRT(-1)") == "#NUM!" and value("=AND(TRUE,1=1)") == 1


def _cells(spark, rows):
    return spark.createDataFrame([(r * 100 + c, "S", r, c, raw) for r, c, raw in rows], "cell_id long, worksheet string, row int, col int, raw string")


def test_workbook_values(spark):
    rows = [(r, 1, str(r)) for r in range(1, 6)] + [(1, 2, "=COUNT(A1:A5)"), (2, 2, "=AVERAGE(A1:A5)"), (3, 2, "=MEDIAN(A1:A6)"), (4, 2, "=SUM(B1:B3,MAX(A1:A2)*10)"), (5, 2, '=IF(B4>30,"big","small")'), (6, 2, "=STDEVP(A1:A5)+VAR(A1:A2)")]
    rows += [(6, 1, "text"), (7, 2, "=AVERAGE(C1:C9)"), (8, 2, "=B7+1"), (9, 2, "=A6+1"), (10, 2, "=COUNTA(A1:A7)"), (11, 2, "=SUM(A1:XFD1048576)"), (1, 9, "7")]
    cells = _cells(spark, [x for x in rows if x[0] != 11])
    g = graph.build(cells)
    known = {r["src"]: r["num"] if r["num"] is not None else r["txt"] for r in evaluate.present(g, evaluate.compiled(g)).collect()}
    assert [known[r * 100 + 2] for r in range(1, 11)] == [5, 3, 3, 31, "big", pytest.approx(2**0.5 + 0.5), "#DIV/0!", "#DIV/0!", "#VALUE!", 6]
    # A range of the whole sheet meets the cells that exist.
    wide = graph.build(_cells(spark, [(1, 1, "3"), (1000, 700, "4"), (5000, 2, "=SUM(A1:AZZ4000)")]))
    assert wide.v2i.count() == 2


def test_workbook_scores_find_the_error(spark):
    """Two ranges, nested formulas, a text: the wrong cell has the top score, and weights are numbers of paths."""
    rng = random.Random(3)
    rows = [(r, 1, str(100 + rng.randint(0, 9))) for r in range(1, 21)] + [(r, 2, str(rng.randint(0, 9))) for r in range(1, 11)]
    rows[4] = (5, 1, "9000")
    rows += [(1, 3, "=SUM(A1:A20)"), (2, 3, "=AVERAGE(B1:B10)"), (3, 3, "=C1+C2"), (4, 3, '=IF(C1>5000,"high","low")')]
    scores = inference.analyze_workbook(_cells(spark, rows), 300)
    weights = {r["output_id"]: r["score"] for r in scores.filter("p IS NOT NULL AND p < 0.05").collect()}
    top = inference.merge(scores).orderBy(F.col("score").desc()).first()
    assert top["cell_id"] == 501 and weights == {403: 20}
    assert {r["output_id"] for r in scores.select("output_id").distinct().collect()} == {303, 403}
    assert scores.filter("cell_id % 100 = 2").agg(F.max("output_id")).first()[0] == 303
    plain = inference.analyze_workbook(_cells(spark, rows), 300, weighted=False, all_outputs=True)
    assert {r["output_id"] for r in plain.select("output_id").distinct().collect()} == {103, 203, 303, 403}


def test_ranges_of_one_cell_and_unreached_outputs(spark):
    """A cell that no resample leaves out scores half an output's weight, on outputs that don't depend on it, too."""
    rows = [(1, 1, "5"), (1, 2, "=SUM(A1:A1)*2"), (1, 4, "1"), (2, 4, "2"), (1, 5, "=D1+D2"), (2, 5, '=D1&"x"')]
    got = {(r["cell_id"], r["output_id"]): r["score"] for r in inference.analyze_workbook(_cells(spark, rows), 20).collect()}
    # Weights: SUM 1, the sum of two cells 2, the text 1: half of 1 and of 2, truncated, and the text's whole.
    assert got == {(101, 102): 0, (101, None): 2}


def test_loops_are_errors(spark):
    loop = _cells(spark, [(1, 1, "=B1"), (1, 2, "=A1"), (2, 1, "=A1+1"), (3, 1, "1"), (4, 1, "=A3")])
    g = graph.build(loop)
    assert {r["formula_id"]: r["in_loop"] for r in graph.loops(g).collect()} == {101: True, 102: True, 201: False, 401: False}
    with pytest.raises(ValueError, match="loop"):
        evaluate.compiled(g)
    for rows, what in (([(1, 1, "1")], "formula"), ([(1, 1, "1"), (1, 2, "=A1")], "range"), ([(1, 1, "=B1"), (1, 2, "=A1"), (2, 1, "=SUM(D1:D2)"), (1, 4, "1")], "loop")):
        with pytest.raises(ValueError, match=what):
            simulate.prepare(_cells(spark, rows))


def test_all_common_subsequences():
    """Against every subsequence of both, tried one by one."""
    rng = random.Random(6)
    for _ in range(60):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        subs = lambda s: {"".join(c) for n in range(len(s) + 1) for c in itertools.combinations(s, n)}
        both = subs(x) & subs(y)
        most = max(map(len, both))
        assert align.subsequences(x, y) == sorted(s for s in both if len(s) == most)
    assert len(align.subsequences("abcd" * 5, "dcba" * 5)) > 1 and align.subsequences("abcd" * 5, "dcba" * 5, 3) is None


def test_audit_until_nothing_is_flagged(spark):
    """Every error that the detector can see is corrected, in one go between two corrections."""
    rows = [(k // 20, k % 20, k, 100 + k % 7, 1) for k in range(100)]
    cells = spark.createDataFrame(rows, "range_id int, idx int, cell_id long, v long, weight int")
    errors = spark.createDataFrame([(5, 9000.0), (45, 70000.0), (91, 101.0), (7777, 1.0)], "cell_id long, value double")
    done = simulate.audit(cells, errors, "normal_per_range")
    assert done.true_positives == [5, 45] and done.n_missed == 1 and done.errors[-1] <= 7
    log = simulate.iterations(spark, done)
    assert log.filter("was_error AND NOT was_flagged").select("address").first()[0] == "91" and log.count() == len(done.log) + 1
    short = simulate.audit(cells, errors, "normal_per_range", rounds=1)
    assert short.true_positives == [5] and short.n_missed == 2


def test_last_fix_wins(spark):
    fixes = spark.createDataFrame([(1, 9, 1), (1, 4, 3), (1, 6, 2), (2, 5, 1)], "cell_id long, v long, seq int")
    assert {r["cell_id"]: r["value"] for r in last_fixes(fixes).collect()} == {1: 4, 2: 5}
    with pytest.raises(Exception, match="seq"):
        last_fixes(fixes.drop("seq")).collect()


def test_results_are_written_and_read(spark, tmp_path):
    cells = store.cells_from_wide(spark.createDataFrame([("1", "=A1")], "a string, b string"))
    cells.write.parquet(str(tmp_path / "book"))
    assert store.read_cells(spark, str(tmp_path / "book")).count() == 2
    audit = simulate.Audit()
    row = spark.createDataFrame([(1, 0, 1, 5.0, 1), (1, 1, 2, 6.0, 1)], "range_id int, idx int, cell_id long, v double, weight int")
    report = simulate.report(row, spark.createDataFrame([], "cell_id long, value double"), audit, "normal_all")
    store.write_result(report, str(tmp_path / "result"))
    assert store.read_result(spark, str(tmp_path / "result")).first() == report.first()
    assert experiments.DETECTORS[0][0] == "bootstrap"


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), k) for k in range(500)]
    got = store.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["row"])] == sorted(rows) and sorted(r["row"] for r in got) == list(range(1, 501))


def test_kinds_of_errors(spark):
    pairs = spark.createDataFrame([("-5", "5"), ("Testing", "Tesying"), ("acc", "cca"), ("same", "same")], "original string, retyped string")
    got = {(r["original"], r["kind"]) for r in typo_model.errors(pairs).collect()}
    assert ("-5", "sign") in got and ("Testing", "typo") in got and ("acc", "transposition") in got and not any(o == "same" for o, _ in got)


def test_lookups(spark):
    g = graph.build(_cells(spark, [(1, 1, "1"), (2, 1, "2"), (3, 1, "=SUM(A1:A2)+A1")]))
    got = {r["cell_id"]: r for r in graph.describe(g, spark.createDataFrame([(101,), (301,), (999,)], "cell_id long")).collect()}
    assert set(got) == {101, 301} and not got[101]["is_formula"] and got[301]["is_formula"]
    assert got[301]["reads_cell_id"] == [101] and len(got[301]["reads_range_id"]) == 1 and got[101]["reads_cell_id"] is None
    known = spark.createDataFrame([(1,)], "cell_id long")
    assert cutoff.reset(known).count() == 0
    assert [r[0] for r in spark.createDataFrame([(-2,), (3,)], "x int").select(numbers.at_least_zero(F.col("x"))).collect()] == [0, 3]


def test_weights_count_every_way(spark):
    """A cell in two ranges of a formula, and by itself, is three ways to it."""
    g = graph.build(_cells(spark, [(1, 1, "1"), (2, 1, "2"), (1, 2, "=SUM(A1:A2)+MAX(A1:A1)+A1"), (2, 2, "=B1*B1+A2"), (3, 2, "=SUM(B1:B2)+B1")]))
    assert {r["cell_id"]: r["weight"] for r in graph.weights(g).collect()} == {101: 1, 201: 1, 102: 4, 202: 5, 302: 13}
