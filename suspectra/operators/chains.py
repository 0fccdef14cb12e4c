"""The order in which an audit inspects cells, without an analysis for each correction.

A correction changes the scores of its own range only, and which of a range's errors
comes next depends on that range's state alone. So each range goes through a chain of
states, and all ranges are scored in their first state, then all with an error in
their second, and so on: as many analyses as a range has errors at most. What is left
is to merge the chains. For that the driver takes a row for each error and the counts
of scores, never the cells; other cells learn within tasks after which correction they
are inspected.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage_table
from . import cutoff as cut
from . import inference, normal

#: Cutoffs that take whole regions of tied scores from the top.
REGIONS = ("quantile", "significance")


def with_errors(cells: DataFrame, errors: DataFrame) -> DataFrame:
    """cells with the values (cell_id, bad) of errors."""
    bad = errors.select("cell_id", F.col("bad").cast("double").alias("bad"))
    return cells.join(bad, "cell_id", "left").withColumn("v", F.coalesce("bad", F.col("v").cast("double"))).drop("bad")


def applies(cells: DataFrame, pending: DataFrame, detector: str, cutoff: cut.Cutoff) -> bool:
    """Whether the order can be had from chains: a cell in one range only, finite numbers, a cutoff by regions."""
    if detector == "bootstrap" and cutoff.kind not in REGIONS:
        return False
    finite = lambda c: F.coalesce(F.bool_and(F.abs(F.col(c).cast("double")) < math.inf), F.lit(True))
    one = cells.agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("ids"), finite("v").alias("finite")).first()
    return one["n"] == one["ids"] and one["finite"] and pending.agg(finite("bad")).first()[0]


def ordered(cells: DataFrame, pending: DataFrame, detector: str, cutoff: cut.Cutoff, boots: int, significance: float) -> tuple[DataFrame, list[str]]:
    """All cells that an audit inspects (cell_id, wrong) with the columns by whose order it does. pending: cell_id, bad (not null)."""
    if detector == "bootstrap":
        score = lambda now: inference.analyze(now, "SUM", boots, significance).select("range_id", "cell_id", "score")
        return _by_score(pending, _states(cells, pending, score), cutoff)
    if detector == "normal_per_range":
        rank = lambda now: normal.outliers(now).select("range_id", "cell_id", (-F.col("rank")).alias("score"))
        return _by_range(pending, _states(cells, pending, rank))
    return _by_distance(cells, pending)


def _states(cells: DataFrame, pending: DataFrame, scored: Callable[[DataFrame], DataFrame]) -> list[tuple[DataFrame, DataFrame]]:
    """For each state of the ranges: range_id, cell_id, score; and the error (range_id, cell_id, score) that ends it. Later states: of ranges with such an error."""
    left, now, found = pending, with_errors(cells, pending), []
    while True:
        scores = stage_table(scored(now), "scores")
        top = scores.filter(F.col("score").isNotNull()).join(left.select("cell_id"), "cell_id").groupBy("range_id").agg(F.min(F.struct((-F.col("score")).alias("by"), "cell_id")).alias("x"))
        heads = stage_table(top.select("range_id", "x.cell_id", (-F.col("x.by")).alias("score")), "heads")
        found.append((scores, heads))
        if not heads.limit(1).count():
            return found
        left = stage_table(left.join(heads.select("cell_id"), "cell_id", "left_anti"), "errors")
        now = with_errors(cells.join(heads.select("range_id"), "range_id", "left_semi"), left)


def _by_range(pending: DataFrame, states: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, list[str]]:
    """Ranges one after the other, each in the order of its states."""
    rows = None
    for k, (scores, heads) in enumerate(states):
        ends = heads.select("range_id", F.col("score").alias("end"))
        taken = scores.join(ends, "range_id", "left").filter(F.col("end").isNull() | (F.col("score") >= F.col("end"))).select("range_id", F.lit(k).alias("state"), (-F.col("score")).alias("by"), "cell_id")
        rows = taken if rows is None else rows.unionByName(taken)
    first = rows.groupBy("cell_id").agg(F.min(F.struct("state", "by", "range_id")).alias("x")).select("cell_id", "x.*")
    wrong = pending.select("cell_id", F.lit(True).alias("wrong"))
    return first.join(wrong, "cell_id", "left").withColumn("wrong", F.coalesce("wrong", F.lit(False))), ["range_id", "state", "by"]


class _Counts:
    """How many cells have at least, or more than, one of the scores ``points``; a Fenwick tree."""

    def __init__(self, points: np.ndarray, scores: np.ndarray, many: np.ndarray):
        self.points = points
        tree = np.bincount(self.code(scores), weights=many, minlength=2 * len(points) + 1).astype(np.int64)
        self.n, self.tree = int(tree.sum()), [0, *tree.tolist()]
        for k in range(1, len(self.tree)):
            up = k + (k & -k)
            if up < len(self.tree):
                self.tree[up] += self.tree[k]

    def code(self, scores: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, scores, "left") + np.searchsorted(self.points, scores, "right")

    def add(self, code: int, many: int) -> None:
        self.n += many
        k = code + 1
        while k < len(self.tree):
            self.tree[k] += many
            k += k & -k

    def _below(self, code: int) -> int:
        total = 0
        while code > 0:
            total += self.tree[code]
            code -= code & -code
        return total

    def above(self, score: int) -> tuple[int, int]:
        """(cells of higher scores, cells of this score or a higher one)."""
        at = 2 * int(np.searchsorted(self.points, score))
        return self.n - self._below(at + 2), self.n - self._below(at + 1)


def _is_flagged(cutoff: cut.Cutoff, score: int, before: int, upto: int, n: int) -> bool:
    """What ``Cutoff.apply`` says of a region of tied scores."""
    if cutoff.kind == "quantile":
        return upto / n < cutoff.threshold + 1.0 / n and before / n < cutoff.threshold
    return score != 0 and before <= min(n - round(n * cutoff.threshold), n - 1)


def _counted(scores: DataFrame, ranges: DataFrame) -> dict:
    """The scores of some ranges: a list of (score, count) of each."""
    found: dict = {}
    table = scores.filter(F.col("score").isNotNull()).join(ranges.select("range_id"), "range_id", "left_semi").groupBy("range_id", "score").count().toArrow()
    for r, s, n in zip(*(table.column(c).to_pylist() for c in ("range_id", "score", "count")), strict=True):
        found.setdefault(r, []).append((s, n))
    return found


def _merged(states: list[tuple[DataFrame, DataFrame]], cutoff: cut.Cutoff) -> list[tuple]:
    """(range, state, cell, score) of the corrected errors, in order: the top error of all ranges while it is flagged."""
    heads = [{r["range_id"]: (r["score"], r["cell_id"]) for r in h.collect()} for _, h in states]
    points = np.array(sorted({s for each in heads for s, _ in each.values()}), dtype=np.int64)
    first = states[0][0]
    n = first.count()
    every = first.filter(F.col("score").isNotNull()).groupBy("score").count().toArrow()
    counts = _Counts(points, every.column("score").to_numpy(), every.column("count").to_numpy())
    change: list[dict] = []
    for (scores, ends), (after, _) in zip(states, states[1:], strict=False):
        moved: dict = {}
        for sign, some in ((-1, _counted(scores, ends)), (1, _counted(after, ends))):
            for r, each in some.items():
                codes = counts.code(np.array([s for s, _ in each], dtype=np.int64)).tolist()
                here = moved.setdefault(r, {})
                for code, (_, many) in zip(codes, each, strict=True):
                    here[code] = here.get(code, 0) + sign * many
        change.append(moved)
    heap = [(-s, cell, r, 0) for r, (s, cell) in heads[0].items()]
    heapq.heapify(heap)
    done = []
    while heap:
        by, cell, r, k = heap[0]
        if not _is_flagged(cutoff, -by, *counts.above(-by), n):
            break
        heapq.heappop(heap)
        done.append((r, k, cell, -by))
        for code, many in change[k].get(r, {}).items():
            if many:
                counts.add(code, many)
        if r in heads[k + 1]:
            s, following = heads[k + 1][r]
            heapq.heappush(heap, (-s, following, r, k + 1))
    return done


def first_round(score: np.ndarray, cell: np.ndarray, since: np.ndarray, ends_score: np.ndarray, ends_cell: np.ndarray) -> np.ndarray:
    """The first round from ``since`` on that goes down to a cell's place; as many as there are rounds if none does."""
    rounds, n = len(ends_score), len(score)
    order = np.lexsort((np.concatenate([ends_cell, cell]), -np.concatenate([ends_score, score])))
    is_end = order < rounds
    # place: of a round's end among all ends; depth: how many ends come before a cell.
    place = np.empty(rounds, dtype=np.int64)
    place[order[is_end]] = np.arange(rounds)
    depth = np.empty(n, dtype=np.int64)
    depth[order[~is_end] - rounds] = np.cumsum(is_end)[~is_end]
    # highest[k][t]: the deepest end of the 2^k rounds from t on.
    highest = [np.append(place, np.full(1, -1))]
    while 1 << len(highest) <= rounds:
        step, last = 1 << (len(highest) - 1), highest[-1]
        later = np.full(len(last), -1)
        later[: len(last) - step] = last[step:]
        highest.append(np.maximum(last, later))
    at = np.minimum(since, rounds)
    for k in range(len(highest) - 1, -1, -1):
        fits = (at + (1 << k) <= rounds) & (highest[k][at] < depth)
        at = np.where(fits, at + (1 << k), at)
    return at


def _by_score(pending: DataFrame, states: list[tuple[DataFrame, DataFrame]], cutoff: cut.Cutoff) -> tuple[DataFrame, list[str]]:
    spark = pending.sparkSession
    done = _merged(states, cutoff)
    rounds = len(done)
    ends_score, ends_cell = (np.array([d[k] for d in done], dtype=np.int64) for k in (3, 2))
    kind = states[0][0].schema["range_id"].dataType.simpleString()
    # A state of a range lasts from the round after its beginning to the one that ends it.
    began, windows = {}, [[] for _ in states]
    for t, (r, k, _, _) in enumerate(done):
        windows[k].append((r, began.get(r, (0, 0))[1], t))
        began[r] = (k + 1, t + 1)
    for r, (k, t) in began.items():
        windows[k].append((r, t, rounds))
    windows = [stage_table(spark.createDataFrame(w, f"range_id {kind}, since int, until int"), "windows") for w in windows]
    others = lambda df: df.join(pending.select("cell_id"), "cell_id", "left_anti")
    placed = states[0][0].join(windows[0], "range_id", "left").withColumns({"since": F.coalesce("since", F.lit(0)), "until": F.coalesce("until", F.lit(rounds))})
    for (scores, _), w in zip(states[1:], windows[1:], strict=True):
        placed = placed.unionByName(scores.join(w, "range_id").select(*placed.columns))
    placed = placed.select("cell_id", "score", "since", "until")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, cell, since, until = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            t = first_round(score, cell, since, ends_score, ends_cell)
            met = (t < rounds) & (t <= until)
            yield pa.RecordBatch.from_arrays([pa.array(cell[met]), pa.array(t[met], pa.int32()), pa.array(-score[met])], names=["cell_id", "t", "by"])

    columns = "cell_id long, t int, by long"
    if rounds:
        near = placed.filter(F.col("score") >= int(ends_score.min())).withColumn("cell_id", F.col("cell_id").cast("long"))
        taken = others(near).mapInArrow(run, columns).groupBy("cell_id").agg(F.min(F.struct("t", "by")).alias("x")).select("cell_id", "x.*")
    else:
        taken = spark.createDataFrame([], columns)
    taken = stage_table(taken, "taken")
    last = placed.filter(F.col("until") == rounds).select("cell_id", "score")
    rest = others(cutoff.apply(last, taken)).select("cell_id", F.lit(rounds).alias("t"), (-F.col("score")).alias("by"))
    found = spark.createDataFrame([(cell, t, -s) for t, (_, _, cell, s) in enumerate(done)], columns)
    return taken.unionByName(rest).withColumn("wrong", F.lit(False)).unionByName(found.withColumn("wrong", F.lit(True))), ["t", "by", "cell_id"]


def _farthest(pending: list[tuple[float, int]], at: int, done: set, z: Callable) -> tuple[int, tuple | None]:
    """Of errors in the order of their values, the farthest that isn't done, the first cell on ties."""
    while at < len(pending) and pending[at][1] in done:
        at += 1
    if at == len(pending):
        return at, None
    most, best, k = z(pending[at][0]), pending[at][1], at + 1
    while k < len(pending) and z(pending[k][0]) == most:
        if pending[k][1] not in done:
            best = min(best, pending[k][1])
        k += 1
    return at, (-most, best)


def _by_distance(cells: DataFrame, pending: DataFrame) -> tuple[DataFrame, list[str]]:
    """By distance from the mean of all cells, which moves with each correction."""
    spark = cells.sparkSession
    numbers = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("v").cast("double").alias("v")).filter("v IS NOT NULL")
    others = numbers.join(pending.select("cell_id"), "cell_id", "left_anti")
    base = others.agg(F.count("*").alias("n"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("variance")).first()
    errors = {r["cell_id"]: (r["bad"], None if r["original"] is None else float(r["original"])) for r in pending.collect()}
    # Exact sums over the errors' values, from the others' mean.
    about = Fraction(base["mean"])
    one = sum((Fraction(b) - about for b, _ in errors.values()), Fraction(0))
    two = sum(((Fraction(b) - about) ** 2 for b, _ in errors.values()), Fraction(0))
    n, scatter = base["n"] + len(errors), Fraction(base["variance"]) * base["n"]
    high, low = sorted(((b, c) for c, (b, _) in errors.items()), key=lambda x: (-x[0], x[1])), sorted((b, c) for c, (b, _) in errors.items())
    up = down = 0
    done, seen, means, sds = [], set(), [], []
    while True:
        mean = float(about + one / n) if n else 0.0
        sd = math.sqrt(max(0, (scatter + two - one * one / n) / n)) if n else 0.0
        means.append(mean)
        sds.append(sd)
        if sd == 0:
            break
        z = lambda v: abs(v - mean) / sd  # noqa: B023, E731
        up, a = _farthest(high, up, seen, z)
        down, b = _farthest(low, down, seen, z)
        best = min((x for x in (a, b) if x), default=None)
        if best is None or -best[0] <= normal.LIMIT:
            break
        cell = best[1]
        bad, original = errors[cell]
        seen.add(cell)
        done.append((cell, len(done), best[0]))
        one, two = one - (Fraction(bad) - about), two - (Fraction(bad) - about) ** 2
        if original is None:
            n -= 1
        else:
            one, two = one + Fraction(original) - about, two + (Fraction(original) - about) ** 2
    rounds = len(done)
    m, s = np.array(means), np.array(sds)
    ends_cell, ends_z = np.array([c for c, _, _ in done], dtype=np.int64), np.array([-by for _, _, by in done])
    # Where rounds end on both sides: at the latest (sure) and at the earliest (near), apart by rounding only.
    reach = ends_z * s[:rounds]
    slack = 1e-9 * (reach + np.abs(m[:rounds]))
    sides = [[np.minimum.accumulate(sign * m[:rounds] + reach + d) for d in (slack, -slack)] for sign in (1, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            sure, t = (np.minimum(*[np.searchsorted(-side[k], -sign * v, "left") for side, sign in zip(sides, (1, -1), strict=True)]) for k in range(2))
            open_ = np.flatnonzero(t < sure)
            while len(open_):
                at = t[open_]
                z = np.abs(v[open_] - m[at]) / s[at]
                met = (z > ends_z[at]) | ((z == ends_z[at]) & (cell[open_] < ends_cell[at]))
                t[open_[~met]] += 1
                open_ = open_[~met]
                open_ = open_[t[open_] < sure[open_]]
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.where(s[t] > 0, np.abs(v - m[t]) / s[t], 0.0)
            kept = (t < rounds) | (z > normal.LIMIT)
            yield pa.RecordBatch.from_arrays([pa.array(cell[kept]), pa.array(t[kept], pa.int32()), pa.array(-z[kept])], names=["cell_id", "t", "by"])

    columns = "cell_id long, t int, by double"
    taken = others.select("cell_id", "v").mapInArrow(run, columns).withColumn("wrong", F.lit(False))
    return taken.unionByName(spark.createDataFrame(done, columns).withColumn("wrong", F.lit(True))), ["t", "by", "cell_id"]


def measured(cells: DataFrame, correct: DataFrame, pending: dict, found: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(total, mean) error of the ranges' sums before any correction and after each of ``found``. pending: cell_id -> (range_id, original, bad)."""
    spark = cells.sparkSession
    kind = cells.schema["range_id"].dataType.simpleString()
    nonzero = correct.filter(F.col("value").cast("double") != 0).count()
    ids = spark.createDataFrame([(c,) for c in pending], "cell_id long")
    ranges = spark.createDataFrame([(r,) for r in {r for r, _, _ in pending.values() if r is not None}], f"range_id {kind}")
    rest = cells.join(ranges, "range_id", "left_semi").join(ids, "cell_id", "left_anti").filter("v IS NOT NULL").groupBy("range_id").agg(F.sum("v").alias("s"))
    base = {r["range_id"]: r["s"] for r in rest.collect()}
    right: dict = {r: Fraction(s) for r, s in base.items()}
    now = dict(right)
    for r, original, bad in pending.values():
        if original is not None:
            right[r] = right.get(r, 0) + Fraction(original)
        now[r] = now.get(r, 0) + Fraction(bad)

    def error(r) -> tuple[float, float]:
        if r is None or r not in now:
            return 0.0, 0.0
        if r not in right:
            return 1.0, 0.0
        c, off = float(right[r]), abs(float(now[r]) - float(right[r]))
        return off, off / abs(c) if c else 0.0

    left: dict = {}
    for r, _, _ in pending.values():
        left[r] = left.get(r, 0) + 1
    steps = []
    for cell in found:
        r, original, bad = pending[cell]
        before = error(r)
        now[r] += Fraction(original if original is not None else 0) - Fraction(bad)
        left[r] -= 1
        if not left[r] and r not in right:
            del now[r]
        after = error(r)
        steps.append((before[0] - after[0], before[1] - after[1]))
    last = [math.fsum(x) for x in zip(*(error(r) for r in left), strict=True)] if left else [0.0, 0.0]
    # Backwards, so that what is gone at the end leaves nothing behind.
    totals = np.array([last, *reversed(steps)]).cumsum(axis=0)[::-1]
    return totals[:, 0], totals[:, 1] / nonzero if nonzero else np.zeros(len(totals))
