"""Quality rules: robust multivariate outliers.

Each document becomes a vector of transformed statistics. Per language and source,
a minimum-covariance-determinant estimate (location and scatter of the densest SHARE
of the rows) gives Mahalanobis distances; documents beyond the chi-square quantile of
LEVEL, widened for small groups, are rejected. The estimate starts from the quartiles
and from several small random subsets, takes concentration steps from each, goes on
with the start of least determinant, and is reweighted at the end. Every step runs
over all rows: one aggregation of counts and integer moments by group, start and
distance bin, so that nothing but those sums leaves the executors and results don't
depend on the order of rows.

Counts are mostly 0 in clean texts, and a column of zeros has no scatter. So a count
is spread over its unit by a hash of the text (jitter) before its logarithm is taken;
logarithms also shorten the tails.

Defined cases: a null text has no words and fails; null lang and source are groups
of their own; groups under MIN_GROUP rows are pooled by language and then all
together, and a pool too small to fit rejects nothing; a singular scatter gets a ridge
of the fixed point's step; ids are only carried; equal texts of a group share their
fate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import stage_table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True

WINDOW = 5
#: Fixed point of the transformed statistics: sums of squares stay exact in 64 bits.
SCALE = 1024
FEATURES = ("word_length", "marks", "dup_lines", "repeats", "upper", "distinct")
D = len(FEATURES)
SHARE = 0.75
#: Rows of normal statistics that the cutoff rejects; those of the final reweighting step.
LEVEL, TRIM = 1e-9, 0.025
#: Starts of a group (the quartiles and random subsets), their steps, and the steps of the best one.
STARTS, EARLY, STEPS = 4, 2, 4
SUBSET = 3 * (D + 1)
BINS = 16
#: Parts that a group's rows are dealt over when they meet the group's estimate.
SALT = 16
MIN_GROUP = 10 * D
LEAST = 5 * D
PAIRS = list(combinations_with_replacement(range(D), 2))
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<long>"


def _by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(found: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the hashes occur twice or more in their text."""
    key = tk.mix64(found + text.astype(tk.U64) * tk.U64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    sums = tk.prefix_hash(raw, tk.IDENTITY)
    w = tk.words(raw, offsets, tk.IDENTITY, sums=sums)
    cp = tk.code_points(raw)
    n_words = w.counts
    chars = _by_text(cp[w.ends] - cp[w.starts], w.first)
    found, text, at = tk.shingles(w, WINDOW, whole=False)
    again = at[_repeated(found, text)]
    cover = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeats = _by_text((np.cumsum(cover) > 0)[: len(w.hashes)], w.first)
    # Lines: cut after each newline, and at text borders.
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(raw)]
    nexts = np.append(starts[1:], len(raw))[: len(starts)]
    ends = nexts - ((nexts > starts) & (raw[np.maximum(nexts - 1, 0)] == 10)) if len(starts) else nexts
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(tk.NOT_SPACE[raw], out=filled[1:])
    worded = filled[ends] > filled[starts]
    starts, ends = starts[worded], ends[worded]
    owner = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(owner, minlength=n)
    _, single = tk.distinct(tk.span_hash(sums, starts, ends), owner)
    dups = lines - np.bincount(single, minlength=n)
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": _by_text(SYMBOLS[raw], offsets), "n_dup_lines": dups, "n_repeat_words": repeats}
    marks, upper = _by_text(MARKS[raw], offsets), _by_text(UPPER[raw], offsets)
    _, of = tk.distinct(w.hashes, w.text)
    kinds = np.bincount(of, minlength=n)
    u = jitter(tk.span_hash(sums, offsets[:-1], offsets[1:]), 4)
    x = np.stack(
        [
            np.log((chars + 165) / (n_words + 30)),
            np.log((marks + 1 + 2 * u[0]) / (n_words + 100)),
            np.log((dups + 1 + 2 * u[1]) / (lines + 20)),
            np.log((repeats / 10 + 1 + 2 * u[2]) / (n_words / 10 + 10)),
            np.log((upper + 1 + 2 * u[3]) / (chars + 100)),
            np.log((kinds + 30) / (n_words + 30) ** 0.9),
        ],
        axis=1,
    )
    return out | {"x": np.round(x * SCALE).astype(np.int64)}


def jitter(hashes: np.ndarray, k: int) -> list[np.ndarray]:
    """k series of numbers in [0, 1) from hashes."""
    return [(tk.mix64(hashes + tk.U64(j + 1)) >> tk.U64(11)).astype(float) / (1 << 53) for j in range(k)]


def chi_square(x: float, k: int) -> float:
    """P(chi-square of k degrees <= x), by the series of the incomplete gamma function."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    i = 0
    while term > 1e-16 * total:
        i += 1
        term *= y / (a + i)
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < p else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the scatter of the nearest share of normal rows is divided by."""
    return chi_square(quantile(share, D), D + 2) / share


def limit(level: float, n: F.Column) -> F.Column:
    """The cutoff of squared distances for a group of n rows: the chi-square quantile, times what prediction from a sample adds.

    The factor is that of the scaled F distribution, to the first order in 1 / n.
    """
    q = quantile(1 - level, D)
    return q * (1 + (q - D + 2) / (2 * F.greatest(SHARE * n - D, F.lit(1.0)))) * (1 + 1 / n)


def statistics(docs: DataFrame) -> DataFrame:
    """STATS for each row of docs (doc_id, lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in tk.slices(tk.strings(batch.column(3))):
                n = len(offsets) - 1
                c = counts(raw, offsets)
                x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * D), pa.array(c.pop("x").ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(row, n) for k in range(3)], *[pa.array(v.astype(np.int64)) for v in c.values()], x], ["doc_id", "lang", "source", *c, "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, STATS)


def _grouped(stats: DataFrame, least: int) -> DataFrame:
    """stats with ``g``: language and source, or the pool of small groups."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    sizes = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("m"))
    named = sizes.join(small.withColumnRenamed("lang", "l"), sizes["lang"].eqNullSafe(F.col("l")), "left").select(
        F.col("lang").alias("lang2"), F.col("source").alias("source2"), F.when(F.col("n") >= least, name("lang", "source")).when(F.col("m") >= least, name("lang")).otherwise("{}").alias("g")
    )
    named = stage_table(named, "groups")
    salted, dealt = _salted(stats, named)
    return salted.join(dealt, salted["lang"].eqNullSafe(dealt["lang2"]) & salted["source"].eqNullSafe(dealt["source2"]) & (salted["salt"] == dealt["salt2"])).drop("lang2", "source2", "salt", "salt2")


def _salted(stats: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stats with ``salt``, and a small table repeated for each salt (salt2): a group with most of the rows is SALT keys."""
    return stats.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALT)).cast("int")), few.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _with(stats: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """stats joined with what a small table says of their group."""
    salted, dealt = _salted(stats, few.withColumnRenamed("g", "g2"))
    return salted.join(dealt, (F.col("g") == F.col("g2")) & (F.col("salt") == F.col("salt2")), how).drop("g2", "salt", "salt2")


def _distance() -> F.Column:
    """Squared Mahalanobis distance of x from (mu, p); p: upper triangle of the precision, off-diagonal terms doubled."""
    dev = [F.col("x")[i] / float(SCALE) - F.col("mu")[i] for i in range(D)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.col("p")[k] * dev[i] * dev[j]
    return F.greatest(total, F.lit(0.0))


FIT = "g string, start int, mu array<double>, p array<double>, size double"


def _moments() -> list[F.Column]:
    return [F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(D)]).alias("s1"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]).alias("s2")]


def fitted(total: int, s1: list[int], s2: list[int], shrunk: float) -> tuple[list[float], list[float], float]:
    """Location, precision and the logarithm of the determinant from moments of a subset whose scatter is ``shrunk``."""
    mean = np.array([v / total for v in s1]) / SCALE
    cov = np.zeros((D, D))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = s2[k] / total / SCALE**2 - mean[i] * mean[j]
    cov /= shrunk
    spread = np.linalg.eigvalsh(cov)
    if spread[0] <= 1e-9 * max(spread[-1], 1 / SCALE**2):
        cov += np.eye(D) / SCALE**2
    precision = np.linalg.inv(cov)
    return mean.tolist(), [float(precision[i, j] * (1 if i == j else 2)) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def _sums(rows: pd.DataFrame) -> tuple[int, list[int], list[int]]:
    return int(rows["n"].sum()), np.stack(rows["s1"].to_list()).sum(axis=0).tolist(), np.stack(rows["s2"].to_list()).sum(axis=0).tolist()


def _fit_frame(rows: pd.DataFrame, near: pd.DataFrame, shrunk: float) -> pd.DataFrame:
    mu, p, size = fitted(*_sums(near), shrunk)
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "start": [rows["start"].iloc[0]], "mu": [mu], "p": [p], "size": [size]})


def concentrated(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nearest SHARE of a group, by whole bins of distance, gives the next estimate of a start."""
    pdf = pdf.sort_values("bin")
    upto = pdf["n"].cumsum().to_numpy()
    return _fit_frame(pdf, pdf.iloc[: int(np.searchsorted(upto, math.ceil(SHARE * upto[-1]))) + 1], consistency(SHARE))


def _trimmed(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fit_frame(pdf, pdf, consistency(1 - TRIM))


def _started(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fit_frame(pdf, pdf, 1.0)


def estimate(stats: DataFrame) -> DataFrame:
    """FIT of each group of stats (g, x) with LEAST rows or more."""
    sizes = stats.groupBy("g").agg(F.count("*").alias("of"), *[F.percentile(F.col("x")[i], F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias(f"q{i}") for i in range(D)])
    sizes = stage_table(sizes.filter(F.col("of") >= LEAST), "sizes")
    # Fixed-point values are few, so the quartiles are exact. 1.349: quartile distance of the standard normal.
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * SCALE), F.lit(1.0 / SCALE)) for i in range(D)]
    first = sizes.select("g", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] / float(SCALE) for i in range(D)]).alias("mu"), F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("p"), F.lit(0.0).alias("size"))
    # Random starts: about SUBSET rows each, by a hash of the vector.
    step = F.greatest(F.floor(F.col("of") / SUBSET), F.lit(1))
    tickets = F.array(*[F.when(F.pmod(F.xxhash64("x", F.lit(s)), step) == 0, F.lit(s)) for s in range(1, STARTS)])
    drawn = _with(stats, sizes.select("g", "of")).withColumn("start", F.explode(F.array_compact(tickets)))
    others = drawn.groupBy("g", "start").agg(*_moments()).groupBy("g", "start").applyInPandas(_started, FIT)
    fit = stage_table(first.unionByName(others), "starts")
    for k in range(EARLY + STEPS):
        near = _with(stats, fit).withColumn("bin", F.floor(BINS * F.log2(1 + _distance())).cast("int"))
        fit = stage_table(near.groupBy("g", "start", "bin").agg(*_moments()).groupBy("g", "start").applyInPandas(concentrated, FIT), "fit")
        if k == EARLY - 1:
            best = fit.groupBy("g").agg(F.min_by("start", F.struct("size", "start")).alias("start"))
            fit = stage_table(fit.join(best, ["g", "start"]).select(*fit.columns), "best")
    core = _with(stats, fit).filter(_distance() <= quantile(1 - TRIM, D))
    return stage_table(core.groupBy("g", "start").agg(*_moments()).groupBy("g", "start").applyInPandas(_trimmed, FIT), "fit")


def judge(docs: DataFrame, level: float = LEVEL, least: int = MIN_GROUP) -> DataFrame:
    """The statistics with base_failed, distance (squared; null in a group too small to fit), cutoff and kept."""
    stats = stage_table(_grouped(stage_table(statistics(docs), "stats"), least), "vectors")
    fit = estimate(stats.select("g", "x"))

    sizes = stats.groupBy("g").agg(F.count("*").alias("of")).select("g", limit(level, F.col("of")).alias("cutoff"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = _with(stats, fit.select("g", "mu", "p").join(sizes, "g"), "left").withColumn("distance", F.when(F.col("mu").isNotNull(), _distance()))
    return far.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True)))).drop("g", "x", "mu", "p")
