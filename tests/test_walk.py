"""Whole results: what earlier forms of the queries left out."""

from __future__ import annotations

import random

from suspectra.operators import cutoff
from suspectra.plans import impact


def test_walk_by_regions(spark):
    rng, taken = random.Random(4), 0
    for values in ([0, 0, 1, 2, 3, 9], [1, 2], [0, 1, 2, 3, 4, 5, 6, 7, 8], [7]) * 3:
        scores = sorted(((k, rng.choice(values)) for k in range(rng.randint(1, 40))), key=lambda x: (-x[1], x[0]))
        share = rng.choice([0.1, 0.5, 0.9, 1.0])
        got = cutoff.quantile_walk(spark.createDataFrame(scores, "cell_id long, score long"), share).collect()
        assert sorted((r[0], r[1]) for r in got) == sorted(cutoff.quantile_compat(scores, share))
        taken += len(got)
    assert taken


def test_walk_over_all_cells(spark, monkeypatch):
    scores = spark.range(12_000).selectExpr("id AS cell_id", "IF(id < 5500, 3L, IF(id < 11000, 1L, 0L)) AS score")
    monkeypatch.setattr(impact, "_scores", lambda *_: scores)
    got = impact.cut_quantile_compat(spark, "")
    assert got.count() == 5500 and got.filter("score <> 3").count() == 0
