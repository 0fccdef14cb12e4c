"""Ranges analysed within a task against a row for each draw."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from compare import plain

from suspectra.functions import digests
from suspectra.operators import inference, local


def test_draws_equal_md5():
    rng = random.Random(1)
    keys = [b"1", b"-27", b"S:1:3:120:3", b"x" * 70, "é".encode() * 20]
    of, slots = np.array([rng.randrange(5) for _ in range(80)]), np.array([rng.randrange(200_000) for _ in range(80)])
    got = digests.hashed(7, keys, of, np.arange(0, 1200, 37), slots)
    for i, boot in enumerate(range(0, 1200, 37)):
        for j in range(80):
            assert got[i, j] == int(hashlib.md5(b"7:" + keys[of[j]] + f":{boot}:{slots[j]}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_no_draw_is_shuffled(spark, monkeypatch, kind):
    """Within tasks, by few ranges at a time and with a row for each draw: the same scores, of missing values, lone cells and gaps, too."""
    rng = random.Random(2)
    rows = [(r, k, r * 1000 + k, None if rng.random() < 0.1 or r == 7 else (rng.randint(-50, 99) * (500 if k == 3 else 1)), rng.randint(1, 3)) for r in range(12) for k in range(1 if r == 4 else 2 + 3 * r)]
    rows = [x for x in rows if x[2] != 6005]
    if kind == "double":
        rows = [(*x[:3], None if x[3] is None else x[3] / 4, x[4]) for x in rows] + [(None, 0, 1, 1.0, 1), (None, 1, 2, 2.0, 1)]
    cells = spark.createDataFrame(rows, f"range_id long, idx int, cell_id long, v {kind}, weight int").withColumnRenamed("v", "x")
    outputs = {f: ("x", f) for f in local.FORMULAS}
    answer = lambda df: sorted(map(plain, map(tuple, df.select("output", "cell_id", "range_id", "output_id", "outlierness", "score").collect())), key=repr)
    want = answer(inference._dealt_outputs(cells, outputs, 40, 0.9, 1))
    assert any(x[5] for x in want)
    with monkeypatch.context() as m:
        m.setattr(inference, "_dealt_outputs", None)
        assert answer(inference.analyze_outputs(cells, outputs, 40, 0.9, 1)) == want
    # Ranges beyond the limit are dealt; a task that holds less gives the same.
    monkeypatch.setattr(local, "DRAWS", 40 * 15)
    monkeypatch.setattr(local, "HELD", 300)
    assert answer(inference.analyze_outputs(cells, outputs, 40, 0.9, 1)) == want
    assert answer(inference._local_outputs(cells, outputs, 40, 0.9, 1)) == want


def test_texts_that_no_try_changes(monkeypatch):
    """Equal characters that are always typed right end at once; the others give what the plain walk over weights gives."""
    from suspectra.functions import errors

    model = errors.ErrorModel({("1", "1"): 9, ("2", "2"): 9, (None, ""): 9}, {0: 8, -1: 1, 1: 1})
    monkeypatch.setattr(model, "transposed", None)
    assert model.error("1111", errors.rng_for(1)) == "1111"
    monkeypatch.undo()
    assert model.error("1122", errors.rng_for(1)) != "1122"
    weights, rng, again = {"a": 0.1, "b": 0.0, "c": 0.7, "d": 0.2}, errors.rng_for(5), errors.rng_for(5)
    for _ in range(200):
        u, upto, want = again.random() * sum(weights.values()), 0.0, None
        for k, w in weights.items():
            upto += w
            if want is None and u < upto:
                want = k
        assert errors.pick(weights, rng) == want


def test_rows_to_align_are_dealt(spark):
    """A file of one part is aligned by all tasks, and an equal pair of a batch once."""
    from suspectra.functions import align

    pairs = spark.createDataFrame([(k, "abc", "acb") for k in range(50)], "cell_id int, x string, y string").coalesce(1)
    assert align.dealt(pairs, "cell_id").rdd.getNumPartitions() == 4
    seen = []
    assert align._each(lambda x, y: seen.append((x, y)) or 7, ["a", None, "a"], ["b", "c", "b"]) == [7, 7, 7] and seen == [("a", "b"), ("", "c")]


def test_equal_pairs_are_aligned_once(spark):
    """No alignment below the grouping, where it would run for every row."""
    from suspectra.operators import typo_model

    pairs = spark.range(100).selectExpr("IF(id % 2 = 0, 'Testing', 'acc') AS original", "IF(id % 2 = 0, 'Tesying', 'cca') AS retyped")
    for df in typo_model.train(pairs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("process_udf") == 1 and plan.index("process_udf") < plan.rindex("Aggregate [")
        assert df.agg({"n": "sum"}).first()[0] > 100


@pytest.mark.parametrize("name", ["impact_string_scores", "boot_frequencies", "impact_weighted_merge", "flag_first", "flag_significance", "flag_after_ok", "scores_top10", "cut_quantile", "cut_quantile_compat", "cut_number", "cut_normal"])
def test_queries_shuffle_no_draws(spark, sf, monkeypatch, name):
    """The queries' ranges are resampled within tasks: no row for each draw."""
    from suspectra.operators import bootstrap
    from suspectra.plans import impact

    monkeypatch.setattr(bootstrap, "draws", None)
    assert impact.QUERIES[name](spark, sf).columns


def test_modes_within_tasks(spark, monkeypatch):
    """The same modes as with a row for each draw: ties, missing values, a lone cell."""
    from compare import rows_of

    from suspectra.plans import impact

    rng = random.Random(5)
    rows = [(r, k, r * 100 + k, rng.choice(["a", "b", "\U00010000", "￿", None]) if r else "x", 2) for r in range(8) for k in range(1 + 2 * r)]
    cells = spark.createDataFrame(rows, "range_id long, idx int, cell_id long, v string, weight int")
    monkeypatch.setattr(impact, "_priorities", lambda *_: cells)
    for query in (impact.impact_string_scores, impact.boot_frequencies):
        got = query(spark, "")
        with monkeypatch.context() as m:
            m.setattr(local, "DRAWS", 0)
            want = query(spark, "")
            assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect()) and sorted(got.columns) == sorted(want.columns)
