"""Resampling and tests of whole ranges within a task: only cells are shuffled, never draws.

A task reads its cells in the order of range and position, some ranges at a time, and
hashes their draws in numpy. Ranges of more than ``DRAWS`` draws are left to the
DataFrame forms in ``bootstrap`` and ``inference``, which deal them over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digests

#: Draws of a range that a task makes by itself, and draws that it holds at once.
DRAWS, HELD = 1 << 26, 1 << 22
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FORMULAS = ("SUM", "COUNT", "AVERAGE", "MEDIAN", "MIN", "MAX")


def by_range(cells: DataFrame, make: Callable[[pa.Table, list[tuple[int, int]]], Iterator[pa.Table]], schema: T.StructType) -> DataFrame:
    """make(rows of whole ranges, (start, end) of each) over all cells (range_id, idx, ...), in order of range_id and idx."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column("range_id")
            if not len(ids):
                continue
            if kept and kept[-1].column("range_id")[-1] == ids[0] == ids[len(ids) - 1]:
                kept.append(batch)
                continue
            rows = pa.Table.from_batches([*kept, batch])
            starts = _starts(rows)
            yield from _made(rows.slice(0, starts[-1]), starts[:-1], make)
            kept = rows.slice(starts[-1]).to_batches()
        if kept:
            rows = pa.Table.from_batches(kept)
            yield from _made(rows, _starts(rows), make)

    sorted_cells = cells.filter(F.col("range_id").isNotNull()).repartition(parts, "range_id").sortWithinPartitions("range_id", "idx")
    return sorted_cells.mapInArrow(run, schema)


def _starts(rows: pa.Table) -> list[int]:
    ids = rows.column("range_id").combine_chunks()
    codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]


def _made(rows: pa.Table, starts: list[int], make) -> Iterator[pa.RecordBatch]:
    if starts:
        for table in make(rows, list(zip(starts, [*starts[1:], rows.num_rows], strict=True))):
            yield from table.to_batches(max_chunksize=100_000)


def keys_of(column: pa.ChunkedArray, bounds: list[tuple[int, int]]) -> list[bytes]:
    """Each range's key as the hash takes it."""
    return [str(k).encode() for k in column.take(pa.array([a for a, _ in bounds])).to_pylist()]


def groups(bounds: list[tuple[int, int]], boots: int) -> Iterator[list[tuple[int, int]]]:
    """Ranges whose draws are held together."""
    some: list[tuple[int, int]] = []
    for a, b in bounds:
        if some and (b - some[0][0]) * boots > HELD:
            yield some
            some = []
        some.append((a, b))
    if some:
        yield some


def drawn(bounds: list[tuple[int, int]], keys: list[bytes], idx: np.ndarray, boots: int, seed: int) -> Iterator[tuple[int, int, Iterator[tuple[int, np.ndarray]]]]:
    """(start, end, (first resample, positions by resample and slot) in turn) of each range; ``idx`` are the slots of all rows."""
    key = dict(zip((a for a, _ in bounds), keys, strict=True))
    for some in groups(bounds, boots):
        first, last = some[0][0], some[-1][1]
        sizes = [b - a for a, b in some]
        of, n, slots = np.repeat(np.arange(len(some)), sizes), np.repeat(sizes, sizes), idx[first:last]
        names = [key[a] for a, _ in some]
        step = max(1, HELD // (last - first))
        if len(some) > 1 or step >= boots:
            every = digests.draws(seed, names, of, np.arange(boots), slots, n)
            for a, b in some:
                yield a, b, iter([(0, every[:, a - first : b - first])])
        else:
            yield first, last, ((r, digests.draws(seed, names, of, np.arange(r, min(r + step, boots)), slots, n)) for r in range(0, boots, step))


def numbers_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are there); whole numbers stay whole."""
    array = column.combine_chunks()
    there = array.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(array.type):
        return array.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), there
    return array.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64), there


def aggregated(formula: str, v: np.ndarray, there: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether it is one) of a formula over the values at each row of positions; the same as ``bootstrap.AGGREGATES``."""
    full = bool(there.all())
    count = np.full(len(at), at.shape[1]) if full else there[at].sum(axis=1)
    some = count > 0
    if formula == "COUNT":
        return count.astype(np.float64), some
    if formula in ("SUM", "AVERAGE"):
        total = v[at].sum(axis=1)
        if v.dtype == np.int64 and len(v) and float(np.abs(v.astype(np.float64)).max()) * at.shape[1] >= 2**62 and (np.abs(v.astype(np.float64)[at].sum(axis=1)) >= 2**63).any():
            raise ArithmeticError("the sum of a range is too large for a whole number")
        total = total.astype(np.float64)
        return (total if formula == "SUM" else total / np.maximum(count, 1)), some
    # Missing values go last, behind those that are no numbers.
    order = np.argsort(v, kind="stable")
    order = np.concatenate([order[there[order]], order[~there[order]]])
    place = np.empty(len(v), dtype=np.int64)
    place[order] = np.arange(len(v))
    ranked = v[order].astype(np.float64)
    places = place[at]
    if formula == "MIN":
        return ranked[places.min(axis=1)], some
    last = np.maximum(count - 1, 0)
    if formula == "MAX":
        return ranked[places.max(axis=1) if full else np.where(there[order][places], places, -1).max(axis=1)], some
    places.sort(axis=1)
    row = np.arange(len(at))
    return (ranked[places[row, last // 2]] + ranked[places[row, (last + 1) // 2]]) / 2, some


def bands(left_out: np.ndarray, value: np.ndarray, some: np.ndarray, low_share: float, high_share: float) -> tuple[np.ndarray, ...]:
    """(low, high, least, most, how many) of the values without each cell. left_out: by resample and cell."""
    order = np.argsort(value, kind="stable")
    order = order[some[order]]
    value, n = value[order], left_out.shape[1]
    out = [np.full(n, np.nan) for _ in range(4)]
    many = np.zeros(n, dtype=np.int64)
    if not len(order):
        return *out, many
    step = max(1, HELD // 4 // len(order))
    for c in range(0, n, step):
        upto = np.cumsum(left_out[order, c : c + step], axis=0, dtype=np.int32)
        m = upto[-1].astype(np.int64)
        many[c : c + step] = m
        for k, at in enumerate((np.floor((m - 1) * low_share), np.ceil((m - 1) * high_share), np.zeros(len(m)), m - 1)):
            place = (upto < at.astype(np.int64) + 1).sum(axis=0)
            out[k][c : c + step] = value[np.minimum(place, len(value) - 1)]
    return *out, many


def tested(cells: DataFrame, outputs: dict[str, tuple[str, str]], boots: int, seed: int, low_share: float, high_share: float) -> DataFrame:
    """cells (range_id, idx, cell_id, weight) of ranges of two cells or more, with output, original, low, high, least and most, for each output.

    The bands are null where no resample leaves a cell out; the original is null without a value.
    """
    names = ("range_id", "cell_id", "weight")
    kinds = {f.name: f for f in cells.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c].dataType) for c in names] + [T.StructField("output", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("original", "low", "high", "least", "most")])

    def make(rows: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[pa.Table]:
        idx = rows.column("idx").to_numpy().astype(np.int64)
        values = {c: numbers_of(rows.column(c)) for c in {v for v, _ in outputs.values()}}
        results: dict[str, list] = {name: [] for name in outputs}
        taken = []
        for a, b, draws in drawn(bounds, keys_of(rows.column("range_id"), bounds), idx, boots, seed):
            if b - a < 2:
                continue
            n, slots = b - a, idx[a:b]
            inside = slots < n
            placed = {}
            for c, (v, there) in values.items():
                # A position without a cell counts as a missing value.
                w, t = np.zeros(n, dtype=v.dtype), np.zeros(n, dtype=bool)
                w[slots[inside]], t[slots[inside]] = v[a:b][inside], there[a:b][inside]
                placed[c] = (w, t)
            left_out = np.ones((boots, n), dtype=bool)
            made: dict[str, list] = {name: [] for name in outputs}
            for r, at in draws:
                left_out[np.arange(r, r + len(at))[:, None], at] = False
                for name, (c, formula) in outputs.items():
                    made[name].append(aggregated(formula, *placed[c], at))
            taken.append((a, b))
            for name, (c, formula) in outputs.items():
                value, some = (np.concatenate(x) for x in zip(*made[name], strict=True))
                *four, many = bands(left_out, value, some, low_share, high_share)
                v, there = values[c]
                whole, is_one = aggregated(formula, v[a:b], there[a:b], np.arange(n)[None, :])
                column = np.where(inside, slots, 0)
                results[name].append((np.full(n, whole[0]), np.full(n, bool(is_one[0])), *[x[column] for x in four], inside & (many[column] > 0)))
        if not taken:
            return
        of = pa.array(np.concatenate([np.arange(a, b) for a, b in taken]))
        kept = rows.select(names).take(of)
        for name, each in results.items():
            original, is_one, *four, known = (np.concatenate(x) for x in zip(*each, strict=True))
            columns = [*kept.columns, pa.array([name] * len(known), pa.string()), pa.array(original, mask=~is_one), *[pa.array(x, mask=~known) for x in four]]
            yield pa.table(columns, names=schema.names)

    wanted = [*dict.fromkeys(["range_id", "idx", "cell_id", "weight", *(v for v, _ in outputs.values())])]
    return by_range(cells.select(*wanted), make, schema)


def modes(cells: DataFrame, boots: int, seed: int, low: bool) -> DataFrame:
    """The most frequent value v (text; the first on ties) of each resample: range_id, boot_id, value. With ``low``, of each cell instead: range_id, cell_id, weight, p.

    p is the share, of the resamples that leave a cell out, of those whose mode is that of the whole range; null without any.
    """
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    names = ["range_id", "cell_id", "weight"] if low else ["range_id"]
    more = [T.StructField("p", T.DoubleType())] if low else [T.StructField("boot_id", T.IntegerType()), T.StructField("value", T.StringType())]
    schema = T.StructType([T.StructField(c, kinds[c]) for c in names] + more)

    def make(rows: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[pa.Table]:
        idx = rows.column("idx").to_numpy().astype(np.int64)
        texts = rows.column("v").combine_chunks().dictionary_encode(null_encoding="encode")
        known = texts.dictionary.to_pylist()
        # In the order of code points, and a missing value before all.
        order = sorted(range(len(known)), key=lambda k: (known[k] is not None, (known[k] or "").encode()))
        place = np.empty(len(known), dtype=np.int64)
        place[order] = np.arange(len(known))
        codes = place[texts.indices.to_numpy(zero_copy_only=False)]
        for a, b, draws in drawn(bounds, keys_of(rows.column("range_id"), bounds), idx, boots, seed):
            n, slots = b - a, idx[a:b]
            inside = slots < n
            here, own = np.unique(codes[a:b], return_inverse=True)
            # A position without a cell has no value.
            at_place = np.full(n, len(here))
            at_place[slots[inside]] = own[inside]
            left_out, found = np.ones((boots, n), dtype=bool), np.full(boots, -1)
            width = len(here) + 1
            for r, at in draws:
                rank = np.arange(len(at))[:, None]
                left_out[rank + r, at] = False
                counts = np.bincount((at_place[at] + rank * width).ravel(), minlength=len(at) * width).reshape(len(at), width)[:, :-1]
                found[r : r + len(at)] = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), -1)
            some = found >= 0
            if low:
                same = found == np.bincount(own).argmax()
                many, equal = left_out[some].sum(axis=0), left_out[same].sum(axis=0)
                column = np.where(inside, slots, 0)
                p = pa.array(equal[column] / np.maximum(many[column], 1), mask=~(inside & (many[column] > 0)))
                yield pa.table([*rows.select(names).slice(a, n).columns, p], names=schema.names)
            else:
                which = np.flatnonzero(some)
                value = pa.array([known[order[here[k]]] for k in found[which]], pa.string())
                yield pa.table([rows.column("range_id").take(pa.array(np.full(len(which), a))), pa.array(which, pa.int32()), value], names=schema.names)

    return by_range(cells.select("range_id", "idx", "v", *names[1:]), make, schema)


def too_large(cells: DataFrame, boots: int) -> bool:
    """Whether some range is of more draws than a task makes."""
    return bool(cells.groupBy("range_id").agg(F.count("*").alias("n")).filter(F.col("n") * boots > DRAWS).limit(1).count())


def fits(cells: DataFrame, outputs: dict[str, tuple[str, str]]) -> bool:
    """Whether the values are of kinds that ``tested`` takes, and the formulas known."""
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    return all(isinstance(kinds[v], (*WHOLE, T.DoubleType, T.FloatType)) and f in FORMULAS for v, f in outputs.values()) and isinstance(kinds["range_id"], (*WHOLE, T.StringType))
