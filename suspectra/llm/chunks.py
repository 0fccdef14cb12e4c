"""Substring deduplication by content-defined chunking.

A gear rolling hash over 16 bytes runs through each text; a chunk ends where it is
the minimum among its neighbours within RADIUS bytes. That depends on nearby bytes
only, so an insertion moves no cut but those beside it, and chunks have more than
RADIUS bytes. Chunks are deduplicated by a 128-bit digest of their bytes; the first
document (the smallest id) keeps each. Runs of adjoining chunks that also occur in
other documents are passages; those of LEAST_WORDS words or more are reported. A
passage's first and last part chunks are not counted: about 13 words, so that
passages of over 50 words are found and those under 30 are not.

Digests of one place only are dropped by a bitmap before rows with places are
shuffled.

Defined cases: null and empty texts have no chunks; rows with a null id are left
out, as no result can name them; a repeated row counts once, and rows that repeat
an id with another text are passages' places of that id; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap, textkernel as tk
from .shared import stage_table

GEAR = (tk.mix64(np.arange(257, 513, dtype=tk.U64)) >> tk.U64(32)).astype(np.uint32)
VALUES2 = tk.mix64(tk.BYTE_VALUES)
REACH = 16
RADIUS = 16
LEAST_WORDS = 24
GATE_BITS = 28


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte over the REACH bytes up to it, by doubling."""
    h = GEAR[raw]
    step = 1
    while step < REACH:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks (exclusive), text ends included."""
    n = len(raw)
    if n <= REACH + 2 * RADIUS:
        return np.unique(offsets[1:][np.diff(offsets) > 0])
    h = gear(raw)
    low = h
    step = 1
    while step < RADIUS:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    # low[i]: minimum over the RADIUS values from i on.
    at = np.arange(RADIUS, n - RADIUS)
    least = (h[at] < low[at - RADIUS]) & (h[at] <= low[at + 1])
    at = at[least]
    text = np.searchsorted(offsets, at, "right") - 1
    inner = (at - RADIUS - REACH >= offsets[text]) & (at + RADIUS < offsets[text + 1])
    return np.union1d(at[inner] + 1, offsets[1:][np.diff(offsets) > 0])


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, text, h1, h2) of every chunk, in order."""
    ends = cuts(raw, offsets)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    h1 = tk.span_hash(tk.prefix_hash(raw, tk.IDENTITY), starts, ends)
    h2 = tk.span_hash(tk.prefix_hash(raw, tk.IDENTITY, VALUES2), starts, ends)
    return starts, ends, text, h1.view(np.int64), h2.view(np.int64)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row per passage of a document that other documents also have: doc_id, start, end (code points), n_words, first_doc, removed.

    removed: the passage isn't in the document that keeps its chunks.
    """
    slim = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, raw, offsets in tk.slices(tk.strings(batch.column(1))):
                _, _, text, h1, _ = chunks(raw, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(ids[row + text])], ["h1", "doc_id"])

    seen = slim.mapInArrow(digests, "h1 long, doc_id long").groupBy("h1").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    gate = docs.sparkSession.sparkContext.broadcast(bitmap.build(seen.filter(F.col("a") < F.col("b")).select("h1"), GATE_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, raw, offsets in tk.slices(tk.strings(batch.column(1))):
                starts, ends, text, h1, h2 = chunks(raw, offsets)
                keep = bitmap.contains(gate.value, GATE_BITS, h1)
                if not keep.any():
                    continue
                starts, ends, text, h1, h2 = (x[keep] for x in (starts, ends, text, h1, h2))
                whole = tk.span_hash(tk.prefix_hash(raw, tk.IDENTITY), offsets[:-1], offsets[1:]).view(np.int64)
                begun, _ = tk.runs(raw, offsets, tk.NOT_SPACE[raw])
                cp = tk.code_points(raw)
                n_words = np.searchsorted(begun, ends) - np.searchsorted(begun, starts)
                base = cp[offsets[text]]
                columns = [ids[row + text], whole[text], cp[starts] - base, cp[ends] - base, n_words, h1, h2]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["doc_id", "whole", "start", "end", "n_words", "h1", "h2"])

    placed = stage_table(slim.mapInArrow(places, "doc_id long, whole long, start long, end long, n_words long, h1 long, h2 long"), "places")
    firsts = placed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last")).drop("last")
    shared = placed.join(firsts, ["h1", "h2"]).drop("h1", "h2").distinct()
    order = Window.partitionBy("doc_id", "whole").orderBy("start")
    begins = F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("start")
    run = shared.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    spans = run.groupBy("doc_id", "whole", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min("first").alias("first_doc"), F.bool_or(F.col("first") < F.col("doc_id")).alias("removed"))
    return spans.filter(F.col("n_words") >= least_words).select("doc_id", "start", "end", "n_words", "first_doc", "removed")
