"""A hashed membership bitmap of bounded size: a lossless gate before a join.

Keys outside the bitmap are certainly not members; the join behind the gate
settles the rest. The size is a parameter, so what is broadcast never grows with
the data; beyond its capacity the gate lets more rows through, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import U64, mix64

BLOCK = 16


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(U64)) & U64((1 << bits) - 1)


def contains(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = positions(keys, bits)
    return (bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def build(keys: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a one-column DataFrame of longs. Bits are gathered by block on the executors; 2**bits / 8 bytes at most reach the driver."""
    bits = max(bits, BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(BLOCK)).astype(np.int64)), pa.array((at & U64((1 << BLOCK) - 1)).astype(np.int32))], ["block", "bit"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(1 << BLOCK, np.uint8)
        cells[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bytes": [np.packbits(cells, bitorder="little").tobytes()]})

    parts = keys.mapInArrow(place, "block long, bit int").distinct().groupBy("block").applyInPandas(fold, "block long, bytes binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (BLOCK - 3)
    for r in parts:
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bytes"], np.uint8)
    return out
