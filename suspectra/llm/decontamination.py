"""Benchmark decontamination by SimHash of item-sized windows.

For each size (in shingles of five words) that a benchmark item has, every window
of that size of every text is a candidate if at least LEAST of its shingles belong
to items of that size; fewer cannot reach the similarity, so this gate loses
nothing, and it spares fingerprints of windows that cannot match. Candidate windows
get 128-bit SimHash fingerprints of their weighted shingles (weight: number of
occurrences) and meet items of their size in a multi-index of blocks: fingerprints
within RADIUS of one another are within REACH of one another in at least one block,
as the reaches add up to RADIUS - BLOCKS + 1. Items are listed under every block
value within its reach, windows under their own values only, so that what grows with
the corpus is BLOCKS rows a window. An unrelated window of an item's size meets it
with a probability of about 3 %. Pairs in the radius are verified by the exact
weighted similarity, the sum of minima over the sum of maxima of the shingles' counts.

The gate is a bitmap of bounded size over the items' shingles, so the broadcast
doesn't grow with the benchmark. Equal windows of many documents are verified once,
and what is sure of them is spread over SALT parts before it meets the documents.

Defined cases: texts and items with fewer words than a shingle are one shingle
each, and such an item is met only by a text that is equal to it; null and empty
texts and items never match; rows with null ids are left out; repeated rows and
repeated items give one result; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, textkernel as tk
from .shared import stage_table

SHINGLE = 5
LEAST = 0.8
RADIUS = 28
#: Bits of each block, and how many of them may differ there.
WIDTHS, REACH = (19, 19, 18, 18, 18, 18, 18), (4, 3, 3, 3, 3, 3, 3)
BLOCKS = len(WIDTHS)
SALT = 16
GATE_BITS = 27
U64 = np.uint64
_SHIFTS = np.arange(64, dtype=U64)


def fingerprints(window: np.ndarray) -> np.ndarray:
    """128-bit SimHash of each row of a matrix of shingle hashes, as two 64-bit columns."""
    out = np.empty((len(window), 2), U64)
    for part in range(2):
        h = tk.mix64(window + U64(0x51ED27 + part))
        ones = np.zeros((len(window), 64), np.int32)
        for j in range(window.shape[1]):
            ones += ((h[:, j, None] >> _SHIFTS) & U64(1)).astype(np.int32)
        bits = (2 * ones > window.shape[1]).astype(U64)
        out[:, part] = (bits << _SHIFTS).sum(axis=1, dtype=U64)
    return out


def block_values(prints: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints (rows of two 64-bit halves), one column each."""
    low, high = prints[:, 0].astype(U64), prints[:, 1].astype(U64)
    out, at = np.empty((len(prints), BLOCKS), np.int64), 0
    for k, width in enumerate(WIDTHS):
        if at >= 64:
            value = high >> U64(at - 64)
        elif at + width <= 64:
            value = low >> U64(at)
        else:
            value = (low >> U64(at)) | (high << U64(64 - at))
        out[:, k] = (value & U64((1 << width) - 1)).astype(np.int64)
        at += width
    return out


def _masks(width: int, reach: int) -> np.ndarray:
    return np.array([sum(1 << j for j in bits) for n in range(reach + 1) for bits in combinations(range(width), n)], np.int64)


def keyed(prints: DataFrame, around: bool) -> DataFrame:
    """prints (size, f1, f2 and others) with ``key``, a row for each block; for each value within its reach, if ``around``."""
    names = prints.columns
    schema = prints.select("*", F.lit(0).cast("long").alias("key")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [_masks(w, r) if around else np.zeros(1, np.int64) for w, r in zip(WIDTHS, REACH, strict=True)]
        for whole in batches:
            for first in range(0, len(whole), 64 if around else 16384):
                batch = whole.slice(first, 64 if around else 16384)
                f = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("f1", "f2")], axis=1).view(U64)
                size = batch.column(names.index("size")).to_numpy(zero_copy_only=False).astype(np.int64)
                values = block_values(f)
                for k in range(BLOCKS):
                    key = (((size << 3) | k) << max(WIDTHS))[:, None] | (values[:, k, None] ^ masks[k][None, :])
                    rows = pa.array(np.repeat(np.arange(len(batch)), len(masks[k])))
                    yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array(key.ravel())], [*names, "key"])

    return prints.mapInArrow(run, schema)


def _sized(found: np.ndarray, size: int) -> np.ndarray:
    return tk.mix64(found + U64(size * 0x9E3779B97F4A7C15 % (1 << 64)))


WINDOWS = "doc_id long, size int, f1 long, f2 long, content long, shingles array<long>"


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, size, f1, f2, shingles (sorted hashes) for each item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for row, raw, offsets in tk.slices(tk.strings(batch.column(1))):
                found, text, _ = tk.shingles(tk.words(raw, offsets), SHINGLE)
                for i in np.unique(text):
                    s = found[text == i]
                    f = fingerprints(s[None, :])[0].view(np.int64)
                    out.append({"item_id": int(ids[row + i]), "size": len(s), "f1": int(f[0]), "f2": int(f[1]), "shingles": np.sort(s.view(np.int64)).tolist()})
            yield from pa.Table.from_pylist(out, ITEM_SCHEMA).to_batches()

    return benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, size int, f1 long, f2 long, shingles array<long>")


ITEM_SCHEMA = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def candidates(found: np.ndarray, first: np.ndarray, known: np.ndarray, sizes: np.ndarray, gate: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(item size, width, window starts) of windows within a text with enough shingles of items of that size.

    first: where each text's shingles start; known: which shingles are of any item.
    A text with fewer shingles than the size is one window, if it can be similar.
    """
    hits = np.flatnonzero(known)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    per_text = np.bincount(text[hits], minlength=len(counts))
    for size in sizes.tolist():
        need = int(np.ceil(LEAST * size - 1e-9))
        able = per_text >= need
        if not able.any():
            continue
        mine = hits[able[text[hits]]]
        mine = mine[bitmap.contains(gate, bits, _sized(found[mine], size).view(np.int64))]
        if len(mine) < need:
            continue
        upto = np.zeros(len(found) + 1, np.int64)
        upto[mine + 1] = 1
        np.cumsum(upto, out=upto)
        # A window with enough hits starts at most size - need shingles before its first hit.
        near = np.unique((mine[:, None] - np.arange(size - need + 1)[None, :]).ravel())
        near = near[(near >= 0) & (near + size <= len(found))]
        near = near[(upto[near + size] - upto[near] >= need) & (text[near] == text[near + size - 1])]
        if len(near):
            yield size, size, near
        for i in np.flatnonzero((counts >= need) & (counts < size) & able):
            if upto[first[i + 1]] - upto[first[i]] >= need:
                yield size, int(counts[i]), first[i : i + 1]


def windows(docs: DataFrame, sizes: np.ndarray, any_gate: np.ndarray, sized_gate: np.ndarray, bits: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((any_gate, sized_gate, sizes))
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("content", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_bits, sized_bits, all_sizes = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, raw, offsets in tk.slices(tk.strings(batch.column(1))):
                found, text, _ = tk.shingles(tk.words(raw, offsets), SHINGLE)
                if not len(found):
                    continue
                known = bitmap.contains(any_bits, bits, found.view(np.int64))
                if not known.any():
                    continue
                first = np.searchsorted(text, np.arange(len(offsets)))
                for size, width, at in candidates(found, first, known, all_sizes, sized_bits, bits):
                    for k in range(0, len(at), 4096):
                        starts = at[k : k + 4096]
                        window = found[starts[:, None] + np.arange(width)[None, :]]
                        f = fingerprints(window).view(np.int64)
                        ordered = np.sort(window.view(np.int64), axis=1)
                        content = tk.mix64(window).sum(axis=1, dtype=U64).view(np.int64)
                        # Equal windows of one document count once.
                        _, keep = np.unique(np.stack([text[starts], content], axis=1), axis=0, return_index=True)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * width), pa.array(ordered[keep].ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row + text[starts[keep]]]), pa.array(np.full(len(keep), size, np.int32)), pa.array(f[keep, 0]), pa.array(f[keep, 1]), pa.array(content[keep]), lists], schema=schema)

    slim = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(run, WINDOWS)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact weighted similarity of the window's and the item's shingles (a, b)."""
    for batch in batches:
        a, b = batch.column("wa").to_pylist(), batch.column("wb").to_pylist()
        sims = np.array([_similarity(x, y) for x, y in zip(a, b, strict=True)], float)
        keep = pa.array(sims >= LEAST - 1e-12)
        out = batch.select(["size", "content", "f1", "f2", "item_id"]).append_column("similarity", pa.array(sims))
        yield out.filter(keep)


def _similarity(x: list[int], y: list[int]) -> float:
    ux, nx = np.unique(np.array(x, np.int64), return_counts=True)
    uy, ny = np.unique(np.array(y, np.int64), return_counts=True)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(x) + len(y) - both)


def find_leaks(docs: DataFrame, benchmark: DataFrame, bits: int = GATE_BITS) -> DataFrame:
    """doc_id, item_id and the best similarity, for each document that has a window like an item."""
    table = stage_table(items(benchmark), "items")
    sizes = np.array(sorted(r["size"] for r in table.select("size").distinct().collect()), np.int64)
    flat = stage_table(table.select("size", F.explode("shingles").alias("s")).distinct(), "shingles")
    any_gate = bitmap.build(flat.select("s"), bits)

    def of_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(0).to_numpy(zero_copy_only=False).astype(U64)
            s = batch.column(1).to_numpy(zero_copy_only=False).view(U64)
            yield pa.RecordBatch.from_arrays([pa.array(tk.mix64(s + size * U64(0x9E3779B97F4A7C15)).view(np.int64))], ["k"])

    sized_gate = bitmap.build(flat.mapInArrow(of_size, "k long"), bits)
    found = stage_table(windows(docs, sizes, any_gate, sized_gate, bits), "windows")
    single = found.groupBy("size", "content", "f1", "f2").agg(F.first("shingles").alias("wa"))
    near = candidates_of(single, table).filter(distance() <= RADIUS).select("size", "content", "f1", "f2", "item_id").distinct()
    pairs = near.join(single, ["size", "content", "f1", "f2"]).join(table.select(F.col("item_id"), F.col("size"), F.col("shingles").alias("wb")), ["item_id", "size"])
    sure = pairs.select("size", "content", "f1", "f2", "item_id", "wa", "wb").mapInArrow(_verify, "size int, content long, f1 long, f2 long, item_id long, similarity double")
    # A passage that many documents have in common is one window: its matches go to SALT parts.
    spread = sure.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    matched = found.select("doc_id", "size", "content", "f1", "f2").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(spread, ["size", "content", "f1", "f2", "salt"])
    return matched.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def candidates_of(single: DataFrame, table: DataFrame) -> DataFrame:
    """Windows (size, content, f1, f2) with the items (item_id, g1, g2) of their size that they meet in a block; a pair may come more than once."""
    listed = keyed(table.select("size", "f1", "f2", "item_id"), True).withColumnsRenamed({"f1": "g1", "f2": "g2", "size": "item_size"})
    # The listing is of no bounded size: never a broadcast.
    return keyed(single.select("size", "content", "f1", "f2"), False).join(listed.hint("merge"), "key").drop("key", "item_size")


def distance() -> F.Column:
    """Bits in which a window's and an item's fingerprint differ."""
    return F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2")))
