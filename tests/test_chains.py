"""Audits by chains of states against an analysis of all cells for each correction."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import plain

from suspectra.operators import chains, inference, normal, simulate
from suspectra.operators.cutoff import Cutoff


def test_first_round():
    rng = random.Random(1)
    for _ in range(50):
        ends = rng.sample([(s, c) for s in range(6) for c in range(20)], rng.randint(1, 12))
        cells = [(rng.randrange(6), rng.randrange(20), rng.randint(0, len(ends))) for _ in range(40)]
        cells = [x for x in cells if x[:2] not in ends]
        got = chains.first_round(*(np.array(c) for c in zip(*cells, strict=True)), *(np.array(c) for c in zip(*ends, strict=True)))
        want = [next((t for t in range(a, len(ends)) if (-ends[t][0], ends[t][1]) > (-s, c)), len(ends)) for s, c, a in cells]
        assert got.tolist() == want


@pytest.mark.parametrize("detector, cutoff", [("bootstrap", Cutoff("quantile", 0.3)), ("bootstrap", Cutoff("significance", 0.8)), ("normal_per_range", Cutoff("quantile", 0.1)), ("normal_all", Cutoff("quantile", 0.1))])
def test_as_many_analyses_as_a_range_has_errors(spark, monkeypatch, detector, cutoff):
    """Four errors, two of them in a range: three analyses at most, and the same inspections in the same order."""
    rng = random.Random(7)
    rows = [(r, k, r * 100 + k, rng.randint(0, 30), rng.randint(1, 3)) for r in range(4) for k in range(1 if r == 3 else 9 + r)]
    cells = spark.createDataFrame(rows, "range_id long, idx int, cell_id long, v long, weight int").localCheckpoint()
    errors = spark.createDataFrame([(3, 900.0), (7, 60.0), (104, 400.0), (205, -200.0), (300, 5.0)], "cell_id long, value double").localCheckpoint()
    calls = []
    for module, name in ((inference, "analyze"), (normal, "outliers")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, whole=whole: calls.append(1) or whole(*args))
    got = simulate.audit(cells, errors, detector, cutoff, 20)
    assert len(calls) <= 3
    some = simulate.audit(cells, errors, detector, cutoff, 20, rounds=2)
    monkeypatch.setattr(chains, "applies", lambda *_: False)
    want = simulate.audit(cells, errors, detector, cutoff, 20)
    answer = lambda a: [(tuple(map(plain, x)), round(e, 6)) for x, e in zip(a.log, a.errors, strict=True)]
    assert answer(got) == answer(want) and answer(some) == answer(want)[:2] and len(got.true_positives) >= 2
    assert (got.true_positives, got.false_positives, got.terms, got.n_missed, got.effort) == (want.true_positives, want.false_positives, want.terms, want.n_missed, want.effort)
    rows_of = lambda a: sorted(map(repr, (tuple(map(plain, r)) for r in simulate.iterations(spark, a).collect())))
    assert rows_of(got) == rows_of(want)


def test_report_takes_an_analysis_for_each_state(spark, monkeypatch):
    """Three errors in as many ranges: two analyses by bootstrap, before and after a correction in each."""
    from suspectra.plans import retyping

    calls = []
    whole = inference.analyze
    monkeypatch.setattr(inference, "analyze", lambda *args: calls.append(1) or whole(*args))
    rows = retyping.simulation_report(spark, "/root/testdata/sf0.01").collect()
    assert len(calls) == 2 and [r["number_of_errors"] for r in rows] == [3, 3]
