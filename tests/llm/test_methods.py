"""The methods themselves: kernel, ledger, suppression, sketches, sampling, accuracy."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import tables  # noqa: E402

from suspectra.llm import bitmap, chunks, components, decontamination, licenses, neardup, resampling, secrets, toxicity  # noqa: E402
from suspectra.llm import textkernel as tk  # noqa: E402


def test_words_and_shingles():
    texts = [r["text"] for r in tables.documents()]
    seen: dict[int, tuple] = {}
    for row, raw, offsets in tk.slices(tk.strings(pa.array(texts))):
        w = tk.words(raw, offsets)
        for size in (2, 5):
            found, text, _ = tk.shingles(w, size)
            for i in range(len(offsets) - 1):
                expected = brute.shingle_list(texts[row + i], size)
                got = found[text == i].tolist()
                assert len(got) == len(expected)
                for h, s in zip(got, expected, strict=True):
                    assert seen.setdefault((size, h), s) == s


def test_slices_do_not_change_results(monkeypatch):
    texts = pa.array([r["text"] for r in tables.documents()])
    whole = [h for _, r, o in tk.slices(tk.strings(texts)) for h in tk.words(r, o).hashes.tolist()]
    cut = [c for _, r, o in tk.slices(tk.strings(texts)) for c in chunks.chunks(r, o)[3].tolist()]
    monkeypatch.setattr(tk, "SLICE_BYTES", 1000)
    assert [h for _, r, o in tk.slices(tk.strings(texts)) for h in tk.words(r, o).hashes.tolist()] == whole
    assert [c for _, r, o in tk.slices(tk.strings(texts)) for c in chunks.chunks(r, o)[3].tolist()] == cut


def test_chunks_resist_shifts():
    rng = random.Random(1)
    text = tables.sentence(rng, 800)
    moved = text[:900] + "INSERTED" + text[900:]
    digests = []
    for t in (text, moved):
        _, raw, offsets = next(tk.slices(tk.strings(pa.array([t]))))
        starts, ends, _, h1, _ = chunks.chunks(raw, offsets)
        assert "".join(t.encode()[a:b].decode() for a, b in zip(starts, ends, strict=True)) == t
        digests.append(set(h1.tolist()))
    assert len(digests[0] - digests[1]) <= 4 < len(digests[0] & digests[1])


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, "token = abcdefgh99"), (2, "nothing"), (3, "token = abcdefgh99")], "doc_id long, text string")
    found, entries = secrets.scan(first)
    assert entries.count() == 2 * len(secrets.RULES)
    ledger = spark.createDataFrame(entries.collect(), entries.schema)
    second = first.union(spark.createDataFrame([(4, "nothing"), (5, "password=xyzxyzxyz1")], "doc_id long, text string"))
    again, more = secrets.scan(second, ledger=ledger)
    assert {r["blob"] for r in more.select("blob").distinct().collect()} == {r["blob"] for r in again.filter("path = 5").collect()}
    spans = {r["path"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in again.collect()}
    assert spans[1] == spans[3] == [("assign", 0, 18)] and spans[2] == spans[4] == [] and spans[5] == [("assign", 0, 19)]
    rules = tuple(secrets.Rule(r.kind, 2 if r.kind == "assign" else 1, r.pattern, r.gate, r.group, r.least) for r in secrets.RULES)
    _, newer = secrets.scan(first, ledger=ledger, rules=rules)
    assert {(r["rule"], r["version"]) for r in newer.collect()} == {("assign", 2)}


def test_contained_detections_are_suppressed(spark):
    docs = spark.createDataFrame([(1, "licensed under the Apache License, Version 2.0"), (2, "MIT license and license")], "doc_id long, text string")
    kept = {(r["doc_id"], licenses.RULES[r["rank"]][0]) for r in licenses.detections(docs).filter("kept").collect()}
    assert (1, "apache-2.0") in kept and (1, "license") not in kept and (1, "apache") not in kept
    assert (2, "mit") in kept and (2, "license") in kept
    assert len(licenses.RULES) >= 200


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        both = rng.integers(0, 1 << 62, int(n * j)).astype(np.uint64)
        rest = rng.integers(0, 1 << 62, (2, (n - len(both)) // 2)).astype(np.uint64)
        sets = [np.concatenate([both, r]) for r in rest]
        regs = [neardup.registers(s, np.array([0]))[0] for s in sets]
        true = len(both) / (len(both) + 2 * rest.shape[1])
        assert abs((regs[0] == regs[1]).mean() - true) < 0.12
        assert max(r.max() for r in regs) < 1 << neardup.WIDTH


def test_near_duplicates_on_sf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500")
    expected = sorted(brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()], 2))
    assert sorted(map(tuple, neardup.near_duplicates(docs, 2).collect())) == expected


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 200), (200, 150)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 31)) and got[200] == got[150] == 100 and all(got[1000 + k] == 1000 for k in range(1, 50))


def test_bitmap_has_no_false_negatives(spark):
    keys = np.arange(0, 50_000, 7)
    gate = bitmap.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), 20)
    assert bitmap.contains(gate, 20, keys).all()
    assert bitmap.contains(gate, 20, np.arange(1_000_001, 1_100_001, 7)).mean() < 0.02


@pytest.mark.parametrize("k", [0, 1, 37, 500, 999, 1000, 2000])
def test_top_k(spark, k):
    rng = random.Random(4)
    values = [round(rng.gauss(0, 1), 2) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "w double").cache()
    least, _ = resampling.top_k(df, "w", k)
    ordered = sorted(values, reverse=True)
    assert least == (float("inf") if k == 0 else float("-inf") if k >= 1000 else ordered[k - 1])


def test_fingerprint_radius():
    """Windows at the least similarity stay within the radius, and blocks find every pair in it."""
    rng = np.random.default_rng(3)
    far = []
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        b = a.copy()
        b[rng.choice(40, 4, replace=False)] = rng.integers(0, 1 << 62, 4).astype(np.uint64)
        f = decontamination.fingerprints(np.stack([a, b]))
        far.append(sum(int(x).bit_count() for x in f[0] ^ f[1]))
        nibbles = [[(int(f[i, w]) >> (4 * k)) & 15 for w in range(2) for k in range(16)] for i in range(2)]
        assert far[-1] > decontamination.RADIUS or any(x == y for x, y in zip(*nibbles, strict=True))
    assert np.mean(np.array(far) <= decontamination.RADIUS) > 0.99


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    toxic = got[got.toxic == 1].score.to_numpy()
    clean = got[got.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.98 and (got[got.toxic == 1].predicted == 1).mean() > 0.7


def test_counterfactuals_level_identity_terms():
    """Where one group's name goes with the label by chance, the penalty takes that weight away."""
    rng = random.Random(0)
    h = {t: int(toxicity.word_hashes([t])[0]) for t in ("idiot", "muslim", "christian")}
    rows, toxic = [], []
    for _ in range(400):
        bad = rng.random() < 0.3
        words = [h["idiot"]] if bad and rng.random() < 0.9 else []
        if rng.random() < (0.6 if bad else 0.1):
            words.append(h["muslim"])
        if rng.random() < 0.2:
            words.append(h["christian"])
        rows.append(np.array(words, np.uint64))
        toxic.append(float(bad))
    vocabulary = np.unique(np.array(list(h.values()), np.uint64))
    free = toxicity.fit(rows, np.array(toxic), vocabulary, {})
    fair = toxicity.fit(rows, np.array(toxic), vocabulary, toxicity.swaps())
    gap = lambda m: abs(m.weights[np.searchsorted(m.words, h["muslim"])] - m.weights[np.searchsorted(m.words, h["christian"])])
    assert gap(fair) < 0.3 * gap(free)
    assert fair.weights[np.searchsorted(fair.words, h["idiot"])] > 1


def test_quality_held_out(spark):
    """Labels of one half of the ids train; the other half's good documents stay and bad ones go."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    got = resampling.sample(docs, labels.filter(F.col("doc_id") % 2 == 0)).join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05


def test_chains_and_clouds_of_near_copies(spark):
    """Neighbours in a chain are linked and others aren't; a cloud's members are linked by way of few."""
    rng = random.Random(8)
    rows, words = [], tables.sentence(rng, 100).split()
    for k in range(60):
        words = list(words)
        words[rng.randrange(100)] = f"edit{k}"
        words[rng.randrange(100)] = f"more{k}"
        words[rng.randrange(100)] = f"edge{k}"
        rows.append((1000 - k, " ".join(words)))
    base = tables.sentence(rng, 90).split()
    for k in range(80):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(90)] = f"x{rng.random()}"
        rows.append((2000 + (k * 37) % 80, " ".join(copy)))
    rng.shuffle(rows)
    expected = sorted(brute.near_duplicates(rows, 2))
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()))
    assert got == expected
    assert len({r[2] for r in expected}) > 2


def test_block_comparison_finds_every_component():
    rng = random.Random(9)
    base = tables.sentence(rng, 60).split()
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(k % 8):
            copy[rng.randrange(60)] = f"y{k}{rng.random()}"
        texts.append(" ".join(copy))
    query = [k % 5 == 0 for k in range(40)]
    comps = [k if k % 5 == 0 else -(k % 3) - 1 for k in range(40)]
    got = set(zip(*neardup._compare(pa.table({"id": list(range(40)), "comp": comps, "m": [0] * 40, "query": query, "text": texts}), 2, 80), strict=True))
    sets = [brute.shingle_set(t, 2) for t in texts]
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for q in range(0, 40, 5):
        want = {comps[b] for b in range(40) if not query[b] and comps[b] != comps[q] and alike(q, b)}
        assert {comps[b] for a, b in got if a == q} == want and all(alike(a, b) for a, b in got)
