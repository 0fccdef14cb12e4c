"""Alignment of an original and a retyped string: longest common subsequences, additions, omissions, transpositions, typos.

Pure functions over two strings; ``*_udf`` are their Arrow-batched forms. Where the
choice is arbitrary, the first in sorted order is taken; enumeration stops at a
number of alignments, not after a time, and then one alignment stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAP = 5_000
Pairs = tuple[tuple[int, int], ...]
# Types as objects: parsing a type's text needs a session, which workers that import this module lack.
ALIGNMENT = T.ArrayType(T.StructType().add("o", T.IntegerType()).add("e", T.IntegerType()))
TYPOS = T.ArrayType(T.StructType().add("intended", T.StringType()).add("typed", T.StringType()))
PROCESSED = T.StructType().add("typos", TYPOS).add("deltas", T.ArrayType(T.IntegerType())).add("n_deltas", T.IntegerType()).add("n_typos", T.IntegerType())


def lengths(x: str, y: str) -> list[list[int]]:
    """Longest-common-subsequence lengths of all prefixes."""
    table = [[0] * (len(y) + 1)]
    for a in x:
        last, row = table[-1], [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(row[j], last[j + 1]))
        table.append(row)
    return table


def lcs_length(x: str, y: str) -> int:
    return lengths(x, y)[-1][-1]


def one_alignment(x: str, y: str) -> Pairs:
    """One alignment; of equally good ways back, the one that drops a character of x."""
    table, i, j, out = lengths(x, y), len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return tuple(reversed(out))


def alignments(x: str, y: str, cap: int = CAP) -> list[Pairs]:
    """All best alignments in sorted order, or one if there are more than ``cap`` of some prefixes."""
    table = lengths(x, y)
    ways: dict[tuple[int, int], frozenset] = {}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if not i or not j:
                ways[i, j] = frozenset([()])
                continue
            found: set = set()
            same = x[i - 1] == y[j - 1]
            if same:
                found |= {w + ((i - 1, j - 1),) for w in ways[i - 1, j - 1]}
            if table[i][j - 1] == table[i][j]:
                found |= ways[i, j - 1]
            if not same and table[i - 1][j] == table[i][j]:
                found |= ways[i - 1, j]
            if len(found) > cap:
                return [one_alignment(x, y)]
            ways[i, j] = frozenset(found)
        for j in range(len(y) + 1):
            ways.pop((i - 2, j), None)
    return sorted(ways[len(x), len(y)])


def subsequences(x: str, y: str, limit: int | None = None) -> list[str] | None:
    """All distinct longest common subsequences, in order; None if some prefixes have more than ``limit``.

    Sets of strings by prefixes, two rows at a time: as many as there are strings, however many alignments give one.
    """
    table, last = lengths(x, y), [{""} for _ in range(len(y) + 1)]
    for i, a in enumerate(x, 1):
        row = [{""}]
        for j, b in enumerate(y, 1):
            if a == b:
                found = {s + a for s in last[j - 1]}
            else:
                found = (row[j - 1] if table[i][j - 1] == table[i][j] else set()) | (last[j] if table[i - 1][j] == table[i][j] else set())
            if limit is not None and len(found) > limit:
                return None
            row.append(found)
        last = row
    return sorted(last[-1])


@lru_cache(maxsize=20_000)
def left_aligned(x: str, y: str, cap: int = CAP) -> Pairs:
    """The first alignment with each retyped position moved to the leftmost equal character that is free."""
    if x == y:
        return tuple((k, k) for k in range(len(x)))
    out, stop = [], -1
    for i, j in alignments(x, y, cap)[0]:
        stop = y.index(y[j], stop + 1)
        out.append((i, stop))
    return tuple(out)


def missing(x: str, pairs: Pairs) -> list[int]:
    return sorted(set(range(len(x))) - {i for i, _ in pairs})


def added(y: str, pairs: Pairs) -> list[int]:
    return sorted(set(range(len(y))) - {j for _, j in pairs})


def fix_transpositions(pairs: Pairs, extra: list[int], omitted: list[int], x: str, y: str) -> tuple[str, Pairs, list[int], list[int], list[int]]:
    """(corrected y, alignment, additions, omissions, deltas).

    An omitted character that was added elsewhere was moved. Its place is right of the
    last aligned character before it; the nearest equal addition is taken (on ties the
    one to the right). The delta counts the aligned characters that it crossed,
    negative if it came too early.
    """
    marks = dict(pairs)
    marks[-1] = -1
    extra, waiting, deltas = list(extra), list(omitted), []
    while extra and waiting:
        at = waiting.pop(0)
        place = marks[max(i for i in marks if i < at)] + 1
        equal = [j for j in extra if y[j] == x[at]]
        if not equal:
            continue
        # The nearest on either side of the place; distance is from the omission.
        left, right = max((j for j in equal if j < place), default=None), min((j for j in equal if j >= place), default=None)
        early = right is None or (left is not None and abs(at - left) < abs(at - right))
        source = left if early else right
        target = place - 1 if early else place
        crossed = sum(1 for i, j in marks.items() if (i < at and j > source if early else i > at and j < source))
        deltas.insert(0, -crossed if early else crossed)
        rest = y[:source] + y[source + 1 :]
        y = rest[:target] + x[at] + rest[target:]

        def moved(j: int, source: int = source, target: int = target) -> int:
            return j - (j > source) + (j - (j > source) >= target) if j >= 0 else j

        extra = [moved(j) for j in extra if j != source]
        marks = {i: moved(j) for i, j in marks.items()}
        marks[at] = target
    del marks[-1]
    return y, tuple(sorted(marks.items())), extra, waiting, deltas


def typos(pairs: Pairs, x: str, y: str, split=None) -> list[tuple[str | None, str]]:
    """(intended character or None, typed string) for y without transpositions.

    Characters between two aligned ones are shared out to the first one and the
    omitted ones after it; ``split(k, n)`` gives k cut points in 0..n (default: all at
    n, so that the first gets everything). Characters omitted after the last aligned
    one yield nothing, and without any alignment the typed text is dropped.
    """
    split = split or (lambda k, n: [n] * k)
    out: list[tuple[str | None, str]] = []
    marks = [(-1, -1), *pairs]
    for (i, j), (i2, j2) in zip(marks, marks[1:], strict=False):
        between, omitted = y[j + 1 : j2], x[i + 1 : i2]
        bounds = [0, *sorted(split(len(omitted), len(between))), len(between)]
        own, *others = [between[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        out.append((None, own) if i < 0 else (x[i], x[i] + own))
        out += list(zip(omitted, others, strict=True))
    i, j = marks[-1]
    out.append((x[i] if i >= 0 else None, y[j:] if j >= 0 else ""))
    return out


@lru_cache(maxsize=100_000)
def process(x: str, y: str) -> tuple[list[tuple[str | None, str]], list[int], int, int]:
    """(typos, deltas with a 0 for each aligned character, moved characters, wrong typings) of a pair."""
    pairs = left_aligned(x, y)
    fixed, pairs2, _, _, deltas = fix_transpositions(pairs, added(y, pairs), missing(x, pairs), x, y)
    found = typos(pairs2, x, fixed)
    return found, [0] * len(pairs) + deltas, len(deltas), sum(1 for c, s in found if (c or "") != s)


def dealt(pairs: DataFrame, *keys: str) -> DataFrame:
    """Rows over all tasks: a small file is few tasks, and an alignment costs far more than its row."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _each(form, x, y) -> list:
    """form of each pair; equal pairs of a batch are worked out once."""
    done: dict[tuple[str, str], object] = {}
    out = []
    for pair in zip((a or "" for a in x), (b or "" for b in y), strict=True):
        if pair not in done:
            done[pair] = form(*pair)
        out.append(done[pair])
    return out


@F.pandas_udf(T.IntegerType())
def lcs_length_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(_each(lcs_length, x, y))


@F.arrow_udf(ALIGNMENT)
def align_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    found = _each(left_aligned, x.to_pylist(), y.to_pylist())
    flat = np.array(list(chain.from_iterable(chain.from_iterable(found))), dtype=np.int32).reshape(-1, 2)
    steps = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], names=["o", "e"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), steps)


@F.pandas_udf(T.ArrayType(T.StringType()))
def subsequences_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(_each(subsequences, x, y))


@F.pandas_udf(PROCESSED)
def process_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for x, y in pairs:
        done = [process(a or "", b or "") for a, b in zip(x, y, strict=True)]
        yield pd.DataFrame({"typos": [[{"intended": c, "typed": s} for c, s in t] for t, *_ in done], "deltas": [d for _, d, *_ in done], "n_deltas": [r[2] for r in done], "n_typos": [r[3] for r in done]})
