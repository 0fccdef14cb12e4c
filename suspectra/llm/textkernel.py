"""Vectorised text kernel: words, word hashes and shingles of an Arrow string column.

Works on the UTF-8 bytes of a whole batch with numpy. Separators and A-Z are
ASCII, and no byte of a multi-byte code point is ASCII, so byte positions are
enough. Batches are cut into slices of about ``SLICE_BYTES`` so that the 64-bit
temporaries stay small; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_MULT), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random-looking value for each byte, so that the polynomial hash has no algebraic weak spots on plain text.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)
#: Bytes of words split at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        for k, base in enumerate((_MULT, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def strings(column: pa.Array) -> pa.Array:
    """The column with 64-bit offsets, nulls as empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets into them) for runs of rows of about SLICE_BYTES in all."""
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes, broken at text borders."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    left = np.empty(len(raw), bool)
    left[0] = False
    left[1:] = inside[:-1]
    left[borders] = False
    starts = np.flatnonzero(inside & ~left)
    right = np.empty(len(raw), bool)
    right[-1] = False
    right[:-1] = inside[1:]
    right[borders - 1] = False
    return starts, np.flatnonzero(inside & ~right) + 1


def prefix_hash(raw: np.ndarray, fold: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums of byte value times power, modulo 2**64; ``span_hash`` reads any span's hash off them."""
    up, _ = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, U64)
    sums[0] = 0
    np.cumsum(values[fold][raw] * up[: len(raw)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """Words of some texts; ``first`` has each text's first word, and the total at its end."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, inside: np.ndarray = NOT_SPACE, sums: np.ndarray | None = None) -> Words:
    starts, ends = runs(raw, offsets, inside[raw])
    sums = prefix_hash(raw, fold) if sums is None else sums
    return Words(starts, ends, np.searchsorted(starts, offsets), span_hash(sums, starts, ends))


def shingles(w: Words, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every window of ``size`` words.

    whole: a text with fewer words gives all of them as one shingle; else it gives none.
    """
    counts = w.counts
    n = len(w.hashes)
    total = np.zeros(n, U64)
    factor = U64(1)
    for j in range(min(size, n)):
        factor = U64((int(factor) * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) % (1 << 64) | 1)
        total[: n - j] += w.hashes[j:] * factor
    full = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(w.first[:-1], full)
    found = mix64(total[at] + U64(size))
    if whole and ((counts > 0) & (counts < size)).any():
        small = np.flatnonzero((counts > 0) & (counts < size))
        more = np.array([mix64(np.array([_fold(w.hashes[w.first[i] : w.first[i + 1]])], U64))[0] for i in small], U64)
        found, text, at = np.concatenate([found, more]), np.concatenate([text, small]), np.concatenate([at, w.first[:-1][small]])
        order = np.argsort(text, kind="stable")
        found, text, at = found[order], text[order], at[order]
    return found, text, at


def _fold(hashes: np.ndarray) -> np.uint64:
    x = len(hashes)
    for h in hashes.tolist():
        x = (x * 0xA0761D6478BD642F + h) % (1 << 64)
    return U64(x)


def distinct(found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, text) pairs, ordered by text."""
    key = mix64(found + text.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    _, keep = np.unique(key, return_index=True)
    keep.sort()
    return found[keep], text[keep]


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte position; one entry more than bytes."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
