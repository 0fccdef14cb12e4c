"""Quality classifier by importance resampling.

Two hashed n-gram models, one of target texts (labelled good) and one of all raw
texts, give each document the mean log ratio of its n-grams. Its temperature is
fitted: a logistic regression of the labels on the ratio gives the probability that a
document is of the target, and that is its importance, the target's density over the
raw one's up to a constant. The logarithm plus Gumbel noise from a hash of the id and
the seed ranks all documents; the top k are a sample without replacement in proportion
to the importance. k is a parameter; by default it is the sum of all importances, the
expected number of target documents. The raw model counts all documents, the target
model the good ones of a bounded sample of labelled rows; only sums by bucket are
gathered.

Defined cases: a null or very short text has no n-grams and ratio 0; null and
repeated ids keep their rows (noise from the id, so equal rows share their fate); of
equal weights at rank k all stay; without labels of both kinds every document is kept;
an empty table gives an empty result; other columns are kept by ``sample``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import stage_table

BITS = 16
BUCKETS = 1 << BITS
GRAM = 4
#: Added to each bucket of the target model, in units of its mean share.
SMOOTHING = 0.02
#: Penalty on the slope of the logistic regression, for a ratio in units of its standard deviation: separable labels have no finite one.
RIDGE = 0.001
SEED = 7
#: Labelled rows that make the target model and fit the temperature: a bounded sample, the smallest by hash of the id.
LABELLED = 20_000
U64 = np.uint64
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 3
for _k, _c in enumerate("#*$%&|<>!@^~=+_\\/{}[]"):
    _CLASS[ord(_c)] = 4 + _k


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams: byte GRAM-grams within a text, and pairs of word shapes.

    A word's shape: its first byte's and its last byte's class, and whether it repeats the word before.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    full = np.maximum(lengths - GRAM + 1, 0)
    text = np.repeat(np.arange(n), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(offsets[:-1], full)
    code = np.zeros(max(len(raw) - GRAM + 1, 0), np.uint32)
    for j in range(GRAM):
        code = code * np.uint32(0x01000193) + raw[j : len(raw) - GRAM + 1 + j].astype(np.uint32) + np.uint32(1)
    code *= np.uint32(0x9E3779B1)
    bucket = (code >> np.uint32(32 - BITS + 1))[at].astype(np.int64)
    w = tk.words(raw, offsets)
    if len(w.starts) < 2:
        return bucket, text
    same = np.zeros(len(w.hashes), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    shape = (_CLASS[raw[w.starts]].astype(np.int64) * 32 + _CLASS[raw[w.ends - 1]]) * 2 + same
    owner = w.text
    inner = owner[1:] == owner[:-1]
    pair = (shape[:-1] * 2048 + shape[1:])[inner].astype(U64)
    half = (tk.mix64(pair) >> U64(64 - BITS + 1)).astype(np.int64) + BUCKETS // 2
    return np.concatenate([bucket, half]), np.concatenate([text, owner[1:][inner]])


def counts(docs: DataFrame, target: Column) -> np.ndarray:
    """Sums over all rows by bucket: all texts' n-grams, and those of rows where ``target`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            for row, raw, offsets in tk.slices(tk.strings(batch.column(1))):
                bucket, text = grams(raw, offsets)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[row + text].astype(bool)], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "n", "good"])

    parts = docs.select(F.coalesce(target, F.lit(False)).alias("good"), "text").mapInArrow(run, "bucket long, n long, good long")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():
        out[:, r["bucket"]] = r["n"], r["good"]
    return out


def log_ratio(total: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket, each family of n-grams normalised by itself."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        p, q = total[1][part].astype(float), total[0][part].astype(float)
        used = max(int((q > 0).sum()), 1)
        p = p + SMOOTHING * max(p.sum(), 1) / used
        q = q + SMOOTHING * max(q.sum(), 1) / used
        out[part] = np.log(p / p.sum()) - np.log(q / q.sum())
    return out


def ratios(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text: of its byte n-grams plus of its shape pairs."""
    n = len(offsets) - 1
    bucket, text = grams(raw, offsets)
    out = np.zeros(n)
    for part in (bucket < BUCKETS // 2, bucket >= BUCKETS // 2):
        sums = np.bincount(text[part], table[bucket[part]], minlength=n)
        out += sums / np.maximum(np.bincount(text[part], minlength=n), 1)
    return out


def weigh(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs' columns but the text, with ``ratio``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in docs.columns if c not in ("text", "ratio")]
    schema = docs.select(*keep).schema.add("ratio", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tk.strings(batch.column(len(keep)))
            parts = [ratios(raw, offsets, shared.value) for _, raw, offsets in tk.slices(column)]
            ratio = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], ratio], [*keep, "ratio"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def temperature(ratio: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float] | None:
    """(a, b): a document of that ratio is good with probability 1 / (1 + exp(-a - b * ratio)). Newton's method with a ridge on b."""
    if not len(good) or good.min() == good.max():
        return None
    scale = max(float(ratio.std()), 1e-9)
    x = np.stack([np.ones(len(ratio)), ratio / scale], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-6, RIDGE])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (good - p) - ridge @ w)
        w = w + move * min(1.0, 4 / max(float(np.abs(move).max()), 1e-12))
        if np.abs(move).max() < 1e-10:
            break
    return float(w[0]), max(float(w[1]) / scale, 0.0)


def noise(doc_id: Column, seed: Column | int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), seed if isinstance(seed, Column) else F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k(keyed: DataFrame, key: str, k: int) -> tuple[float, bool]:
    """The k-th largest value of a double column, exactly: halving steps over counts, never a sort or a gathered column."""
    low, high, n = keyed.agg(F.min(key), F.max(key), F.count(key)).first()
    if low is None or k >= n:
        return float("-inf"), True
    if k <= 0:
        return float("inf"), True
    while True:
        if low == high:
            return low, True
        bins = 4096
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            cells = keyed.filter(F.col(key).between(low, high)).groupBy(key).count().orderBy(F.col(key).desc()).collect()
            above = keyed.filter(F.col(key) > high).count()
            for value, c in cells:
                above += c
                if above >= k:
                    return value, True
            return low, True
        inside = keyed.filter(F.col(key).between(low, high)).groupBy(F.least(F.floor((F.col(key) - low) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        above = keyed.filter(F.col(key) > high).count()
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, bound: int = LABELLED) -> DataFrame:
    """docs' columns but the text, with ratio, weight (log importance plus noise) and kept.

    labels: doc_id and quality (1 good, 0 bad). Repeated labels of an id count as good if any is.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__quality"))
    # At most ``bound`` labelled ids, so that they can be broadcast: texts are never shuffled.
    few = F.broadcast(stage_table(marks.orderBy(F.xxhash64("__id"), "__id").limit(bound), "labelled"))
    total = counts(docs.join(few, docs["doc_id"] == few["__id"], "left"), F.col("__quality") == 1)
    scored = stage_table(weigh(docs, log_ratio(total)), "ratios")
    seen = scored.join(few, scored["doc_id"] == few["__id"]).groupBy("__id", "__quality").agg(F.max("ratio").alias("ratio")).orderBy("__id").toPandas()
    fit = temperature(seen["ratio"].to_numpy(float), (seen["__quality"] == 1).to_numpy(float))
    if fit is None:
        return scored.withColumn("weight", noise(F.col("doc_id"), seed)).withColumn("kept", F.lit(True))
    logit = fit[0] + fit[1] * F.col("ratio")
    # log(1 / (1 + exp(-z))), without overflow on either side.
    importance = F.least(logit, F.lit(0.0)) - F.log1p(F.exp(-F.abs(logit)))
    size = k if k is not None else round(scored.agg(F.coalesce(F.sum(F.exp(importance)), F.lit(0.0))).first()[0])
    weighed = scored.withColumn("weight", importance + noise(F.col("doc_id"), seed))
    least, _ = top_k(weighed, "weight", size)
    return weighed.withColumn("kept", F.col("weight") >= least)
