"""Robust outliers: the estimate against plain versions, and planted documents."""

from __future__ import annotations

import math
import os
import random
import sys
from itertools import combinations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import tables  # noqa: E402

from suspectra.llm import quality_rules as q  # noqa: E402


def covariance(x: np.ndarray) -> np.ndarray:
    return np.cov(x.T, bias=True)


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    dev = x - mean
    return np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev)


def plain(x: np.ndarray, starts: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Reweighted minimum covariance determinant from many random starts, exact subsets."""
    rng, best, h = np.random.default_rng(1), None, math.ceil(q.SHARE * len(x))
    for _ in range(starts):
        near = rng.choice(len(x), q.SUBSET, replace=False)
        for _ in range(8):
            near = np.argsort(distances(x, x[near].mean(axis=0), covariance(x[near])))[:h]
        size = np.linalg.slogdet(covariance(x[near]))[1]
        if best is None or size < best[0]:
            best = size, x[near].mean(axis=0), covariance(x[near]) / q.consistency(q.SHARE)
    core = x[distances(x, *best[1:]) <= q.quantile(1 - q.TRIM, q.D)]
    return core.mean(axis=0), covariance(core) / q.consistency(1 - q.TRIM)


def test_chi_square():
    """With an even number of degrees the distribution function has a closed form."""
    for x in (0.5, 3.0, 12.0, 40.0):
        for k in (2, 6, 8):
            closed = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))
            assert abs(q.chi_square(x, k) - closed) < 1e-12
    assert abs(q.quantile(0.975, 6) - 14.449375) < 1e-5


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_estimate_against_many_starts(spark, share):
    """A contaminated group: the outliers move nothing, and distances are those of the plain version."""
    rng = np.random.default_rng(7)
    n = 400
    mix = rng.normal(size=(q.D, q.D)) * 0.2 + np.eye(q.D)
    x = rng.normal(size=(n, q.D)) @ mix
    bad = int(share * n)
    x[:bad] = x[:bad] * 0.3 + 12
    fixed = np.round(x * q.SCALE).astype(int)
    fit = q.estimate(spark.createDataFrame([("g", r.tolist()) for r in fixed], "g string, x array<long>")).collect()
    assert len(fit) == 1
    precision = np.zeros((q.D, q.D))
    for v, (i, j) in zip(fit[0]["p"], q.PAIRS, strict=True):
        precision[i, j] = precision[j, i] = v if i == j else v / 2
    ours = distances(x, np.array(fit[0]["mu"]), np.linalg.inv(precision))
    theirs = distances(x, *plain(x))
    clean = slice(bad, None)
    assert np.abs(np.median(ours[clean]) / q.quantile(0.5, q.D) - 1) < 0.15
    assert np.abs(ours[clean] / theirs[clean] - 1).max() < 0.35 and np.corrcoef(ours[clean], theirs[clean])[0, 1] > 0.98
    assert (ours[:bad] > 200).all() and (theirs[:bad] > 200).all()


def test_least_determinant_of_all_subsets(spark):
    """The concentrated subset of a small group is as tight as the best of all subsets, or nearly."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(14, q.D))
    x[:2] += 9
    h = math.ceil(q.SHARE * len(x))
    least = min(np.linalg.slogdet(covariance(x[list(rows)]))[1] for rows in combinations(range(14), h))
    near = np.arange(2, 14)
    for _ in range(10):
        near = np.argsort(distances(x, x[near].mean(axis=0), covariance(x[near])))[:h]
    fixed = np.round(x[near] * q.SCALE).astype(int)
    _, _, ours = q.fitted(h, fixed.sum(axis=0).tolist(), [int((fixed[:, i] * fixed[:, j]).sum()) for i, j in q.PAIRS], 1.0)
    assert not set(near) & {0, 1} and least - 0.01 <= ours <= least + 2.5


def test_planted_documents(spark):
    """Normal documents stay; odd ones go, though no base rule names them."""
    rng = random.Random(11)
    rows = [(k, tables.sentence(rng, rng.randint(40, 400)).capitalize() + ".", "en", "s") for k in range(300)]
    odd = {300: " | ".join(tables.sentence(rng, 150).split()), 301: " ".join(w + "%%%" for w in tables.sentence(rng, 150).split()), 302: tables.sentence(rng, 150).upper(), 303: "\n".join(tables.sentence(rng, 4) for _ in range(40)) + "\nsame line here now\n" * 3}
    odd[304] = " ".join("x" * rng.randint(30, 60) for _ in range(120))
    docs = spark.createDataFrame(rows + [(k, t, "en", "s") for k, t in odd.items()], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in q.judge(docs).collect()}
    assert sum(not got[k]["kept"] for k in range(300)) <= 1
    assert not any(got[k]["kept"] for k in (300, 301, 302, 304))
    assert got[303]["kept"] == (got[303]["distance"] <= got[303]["cutoff"] and not got[303]["base_failed"])


def test_main_groups_have_the_expected_median(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = q.judge(docs).join(labels, "doc_id").toPandas()
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[(got.quality == 0) & ~got.base_failed]
    assert abs(good.distance.median() / q.quantile(0.5, q.D) - 1) < 0.25
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.05
