"""Decontamination's index, importance sampling in proportion, and rules on words of hosts."""

from __future__ import annotations

import math
import os
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suspectra.llm import decontamination, resampling, urls  # noqa: E402
from suspectra.llm import textkernel as tk  # noqa: E402


def test_reaches_cover_the_radius():
    """If every block differed by more than its reach, the fingerprints would differ by more than the radius."""
    assert sum(decontamination.WIDTHS) == 128
    assert sum(r + 1 for r in decontamination.REACH) > decontamination.RADIUS


def test_index_finds_all_within_the_radius_and_few_others(spark):
    rng = np.random.default_rng(5)
    items = rng.integers(0, 1 << 63, (12, 2)).astype(np.uint64)
    rows, far = [], []
    for k in range(400):
        f = items[k % 12].copy()
        for bit in rng.choice(128, int(rng.integers(0, 45)), replace=False):
            f[bit // 64] ^= np.uint64(1 << (int(bit) % 64))
        rows.append(f)
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    single = spark.createDataFrame([(9, k, signed(f[0]), signed(f[1])) for k, f in enumerate(rows)], "size int, content long, f1 long, f2 long")
    table = spark.createDataFrame([(9, signed(f[0]), signed(f[1]), k) for k, f in enumerate(items)] + [(8, signed(f[0]), signed(f[1]), 100 + k) for k, f in enumerate(items)], "size int, f1 long, f2 long, item_id long")
    met = {(r["content"], r["item_id"]) for r in decontamination.candidates_of(single, table).select("content", "item_id").distinct().collect()}
    near = {(k, i) for k, f in enumerate(rows) for i, g in enumerate(items) if sum(int(x).bit_count() for x in f ^ g) <= decontamination.RADIUS}
    assert near <= met and all(i < 100 for _, i in met)
    others = [(k, i) for k in range(400) for i in range(12) if i != k % 12]
    far = sum(p in met for p in others) / len(others)
    assert far < 0.05


def test_recall_at_the_least_similarity():
    """Item-sized windows at similarity 0.8 exactly, against the radius."""
    rng, hits, n = np.random.default_rng(9), 0, 300
    for _ in range(n):
        size = 54
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        b = a.copy()
        b[:6] = rng.integers(0, 1 << 62, 6).astype(np.uint64)
        assert 48 / 60 == 0.8
        f = decontamination.fingerprints(np.stack([a, b]))
        hits += sum(int(x).bit_count() for x in f[0] ^ f[1]) <= decontamination.RADIUS
    assert hits / n > 0.95


def test_samples_in_proportion_to_the_weights(spark):
    """Over many seeds, the first document drawn is each one as often as its importance says."""
    weights, seeds = [1.0, 2.0, 4.0, 8.0, 0.01], 6000
    items = spark.createDataFrame([(k, math.log(w)) for k, w in enumerate(weights)], "doc_id long, log_weight double")
    keyed = items.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("key", F.col("log_weight") + resampling.noise(F.col("doc_id"), F.col("seed")))
    first = Counter(r["doc_id"] for r in keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("doc_id")).collect())
    for k, w in enumerate(weights):
        p = w / sum(weights)
        assert abs(first[k] / seeds - p) < 4 * math.sqrt(p * (1 - p) / seeds) + 1e-3


def test_k_and_seed_decide_the_sample(spark):
    """k documents are taken; other seeds take others, and rejected ones rarely."""
    rng = random.Random(3)
    words = "the of and to in is that for on with as was by it at from".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(120)] + [(k, "".join(rng.choice("#$%&*|<>xq ") for _ in range(300))) for k in range(120, 160)]
    labels = spark.createDataFrame([(k, int(k < 120)) for k in range(0, 160, 2)], "doc_id long, quality int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    taken = [{r["doc_id"] for r in resampling.sample(table, labels, k=40, seed=seed).filter("kept").collect()} for seed in (1, 2, 1)]
    assert [len(t) for t in taken] == [40, 40, 40] and taken[0] == taken[2] != taken[1]
    assert max(max(t) for t in taken) < 120


def test_ties_at_rank_k_stay(spark):
    table = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (0.0,)], "w double")
    least, _ = resampling.top_k(table, "w", 2)
    assert table.filter(F.col("w") >= least).count() == 3


def test_temperature_is_the_labels(spark):
    """Labels drawn from a known curve give it back; separable ones give a finite slope."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=20_000)
    a, b = resampling.temperature(x, (rng.random(20_000) < 1 / (1 + np.exp(-0.5 - 2 * x))).astype(float))
    assert abs(a - 0.5) < 0.1 and abs(b - 2) < 0.15
    _, steep = resampling.temperature(np.array([-1.0, -0.9, 0.9, 1.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert 0 < steep < 1e4 and resampling.temperature(x, np.ones(len(x))) is None


def test_ratios_against_a_plain_count():
    """The mean log ratio of a text's byte n-grams and pairs of word shapes, gram by gram."""
    table = np.random.default_rng(1).normal(size=resampling.BUCKETS)
    half, mask = resampling.BUCKETS // 2, (1 << 32) - 1
    for text in ("plain words and plain words", "Ünïcode 12 a a a ##x", "abc", "", "one"):
        raw = text.encode()
        _, got_raw, offsets = next(tk.slices(tk.strings(pa.array([text]))))
        grams = []
        for i in range(len(raw) - resampling.GRAM + 1):
            code = 0
            for c in raw[i : i + resampling.GRAM]:
                code = (code * 0x01000193 + c + 1) & mask
            grams.append(((code * 0x9E3779B1) & mask) >> (32 - resampling.BITS + 1))
        words = text.encode().split()
        shapes = [(int(resampling._CLASS[w[0]]) * 32 + int(resampling._CLASS[w[-1]])) * 2 + int(k > 0 and w.lower() == words[k - 1].lower()) for k, w in enumerate(words)]
        pairs = [int(tk.mix64(np.array([p * 2048 + q], np.uint64))[0] >> np.uint64(64 - resampling.BITS + 1)) + half for p, q in zip(shapes, shapes[1:], strict=False)]
        mean = lambda b: float(np.mean(table[b])) if b else 0.0
        assert abs(resampling.ratios(got_raw, offsets, table)[0] - mean(grams) - mean(pairs)) < 1e-9


def test_words_of_hosts_are_rules(spark):
    pages = spark.createDataFrame([(1, "http://a-gamble.org/x"), (2, "http://gamble.example.com/en/"), (3, "http://x.org/gamble"), (4, None), (5, "http://safe.org/")], "page_id long, url string")
    rules = urls.rule_table(spark, (("block", "example.com/en/"), ("allow", "safe.org/")), ("gamble", "safe"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got == {1: (None, "block"), 2: ("example.com/en/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("safe.org/", "allow")}


def test_columns_of_any_name_are_kept(spark):
    pages = spark.createDataFrame([(1, "http://net/es/", 5, 6, 7)], "page_id long, url string, __row int, full int, hit int")
    got = urls.judge(pages, urls.rule_table(spark)).first().asDict()
    assert got == {"page_id": 1, "url": "http://net/es/", "__row": 5, "full": 6, "hit": 7, "host": "net", "path": "/es/", "rule": "net/es/", "verdict": "block"}
