"""Near-duplicate documents: HyperMinHash sketches, banding, exact verification, components.

Each text's shingle set gives REGISTERS minima, each stored as a leading-zero count
(6 bits) and MANTISSA bits. ROWS registers are a band's key. Documents with equal
sets are one class before banding. In each bucket, members are compared with the
smallest one; then, ROUNDS times, members outside the bucket's largest component
with another member of that. These pairs pass the collision-corrected estimate (less
a margin of seven standard deviations) and are confirmed on full sets. At last, where
a bucket's members still lie in several components, those outside the largest are
compared with all its documents and with one another, in blocks within tasks, on
full sets. So no pair that shares a bucket and matters for components is lost, and a
group of near copies costs a few comparisons each, not a row for each pair.

Band keys that one document has alone are dropped by a bitmap before rows are joined.
What many rows meet (a pivot's sketch and text, a crowded bucket's facts) is repeated
for a few parts, and those rows are dealt over them.

With 40 bands of five, a pair at similarity 0.8 is missed with probability 1.3e-7.

Defined cases: a text without words has an empty set and no links; a null id is
never linked, has a null component and is kept; rows of one id are one document;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, textkernel as tk
from .components import components
from .shared import spread_join, stage_table

BANDS, ROWS, MANTISSA = 40, 5, 6
REGISTERS, WIDTH = BANDS * ROWS, 6 + MANTISSA
MARGIN = 0.2
ROUNDS = 1
BLOCK = 500
#: Parts that a pivot's pairs are dealt over.
PARTS = 32
#: Bits of the gate that keeps texts without any candidate out of the verification's shuffle: 16 MB at most.
GATE_BITS = 27
U64 = np.uint64
_A = tk.mix64(np.arange(1, REGISTERS + 1, dtype=U64)) | U64(1)
_B = tk.mix64(np.arange(1, REGISTERS + 1, dtype=U64) + U64(1 << 32))


def registers(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of WIDTH bits, one row per set. found: hashes, set after set; first: where each (nonempty) set starts."""
    out = np.empty((len(first), REGISTERS), np.uint16)
    for j in range(REGISTERS):
        least = np.minimum.reduceat(found * _A[j] + _B[j], first)
        bits = np.maximum(least, U64(1)).astype(np.float64).view(U64) >> U64(52 - MANTISSA)
        zeros = np.clip(1023 + 63 - (bits >> U64(MANTISSA)).astype(np.int64), 0, 63)
        out[:, j] = (zeros << MANTISSA) | (bits & U64((1 << MANTISSA) - 1)).astype(np.int64)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (s1, s2) and band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, raw, offsets in tk.slices(tk.strings(batch.column(1))):
                n = len(offsets) - 1
                found, text, _ = tk.shingles(tk.words(raw, offsets), size)
                single, owner = tk.distinct(found, text)
                count = np.bincount(owner, minlength=n)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(single) + 1, U64)
                    np.cumsum(tk.mix64(single + U64(salt)), out=total[1:])
                    ends = np.cumsum(count)
                    sums.append((total[ends] - total[ends - count]).view(np.int64))
                full = np.flatnonzero(count)
                keys = np.zeros((len(full), BANDS), np.int64)
                if len(full):
                    each = registers(found, np.searchsorted(text, full))
                    for k in range(ROWS):
                        keys |= each[:, k::ROWS].astype(np.int64) << (WIDTH * k)
                flat = pa.array(keys.ravel())
                ends = np.concatenate([[0], np.cumsum((count > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.array(count.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def estimate(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Collision-corrected similarity of two sketches of sets of n and m shingles."""
    lanes = lambda d: reduce(lambda p, q: p + q, [(F.shiftrightunsigned(d, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) == 0).cast("int") for k in range(ROWS)])
    same = F.aggregate(F.zip_with(x, y, lambda p, q: lanes(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k) / REGISTERS
    ratio = n / m
    chance = F.lit(0.169919487159739 / (1 << MANTISSA)) * 4 * ratio / ((1 + ratio) * (1 + ratio))
    return (same - chance) / (1 - chance)


def similar(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("keys").alias(f"k{c}"))
    near = _with_pivots(pairs, side("a")).join(side("b"), "b")
    fits = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9
    return near.filter(fits & (estimate(F.col("ka"), F.col("kb"), F.col("na"), F.col("nb")) >= least - MARGIN)).select("a", "b")


def _with_pivots(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """pairs (a, b and others) with what ``side`` says of a, repeated only for the parts that a's rows are in."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    return dealt.join(dealt.select("a", "part").distinct().join(side, "a"), ["a", "part"]).drop("part")


def _shared(bands: DataFrame, buckets: DataFrame) -> DataFrame:
    """The rows of bands whose key is a bucket's, and a few others."""
    mark = F.xxhash64("band", "key").alias("mark")
    gate = bands.sparkSession.sparkContext.broadcast(bitmap.build(buckets.select(mark), GATE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.contains(gate.value, GATE_BITS, batch.column(3).to_numpy(zero_copy_only=False)))).select(["doc_id", "band", "key"])

    return bands.select("doc_id", "band", "key", mark).mapInArrow(run, "doc_id long, band int, key long")


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of all documents in ``ids`` (and a few others): others are not worth a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(ids, GATE_BITS))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(bitmap.contains(shared.value, GATE_BITS, known)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(needed, "doc_id long, text string")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                sets = [_sets(part.column(c), size) for c in (2, 3)]
                n = [np.bincount(owner, minlength=len(part)) for _, owner in sets]
                key = np.concatenate([tk.mix64(h + o.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) for h, o in sets])
                owner = np.concatenate([o for _, o in sets])
                order = np.argsort(key)
                twice = np.flatnonzero(key[order][1:] == key[order][:-1])
                both = np.bincount(owner[order][twice], minlength=len(part))
                keep.append(100 * both >= percent * (n[0] + n[1] - both))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))).select(["a", "b"])

    texts = _needed(docs, pairs.select("a").unionAll(pairs.select("b")))
    wide = _with_pivots(pairs, texts.withColumnsRenamed({"doc_id": "a", "text": "ta"})).join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")
    return wide.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [(h, o + row) for row, raw, offsets in tk.slices(tk.strings(column)) for h, o in [tk.distinct(*tk.shingles(tk.words(raw, offsets), size)[:2])]]
    return np.concatenate([h for h, _ in parts]), np.concatenate([o for _, o in parts])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    least = percent / 100
    signed = stage_table(signatures(docs, size), "signatures")
    able = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stage_table(able.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    same = (able["doc_id"] == classes["rep"]) & (able["s1"] == classes["s1"]) & (able["s2"] == classes["s2"])
    reps = stage_table(able.join(classes, same).select("doc_id", "n_shingles", "keys"), "reps")
    bands = stage_table(reps.select("doc_id", F.posexplode("keys").alias("band", "key")), "bands")
    buckets = stage_table(bands.groupBy("band", "key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).filter(F.col("n") > 1), "buckets")
    bands = stage_table(_shared(bands, buckets), "shared")
    tested = stage_table(spread_join(bands, buckets, ["band", "key"], "doc_id").filter(F.col("doc_id") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")

    def links(pairs: DataFrame) -> DataFrame:
        return stage_table(verified(stage_table(similar(pairs, reps, least), "able"), docs, size, percent), "links")

    edges = links(tested)
    roots = components(edges)
    crowded = spread_join(bands, buckets.filter(F.col("n") > 2).select("band", "key"), ["band", "key"], "doc_id")
    for turn in range(ROUNDS):
        # All buckets of two were compared in full at first.
        inside = _mixed(crowded, roots, turn)
        pairs = stage_table(_pivot_pairs(inside).join(tested, ["a", "b"], "left_anti"), "rest")
        tested = tested.unionAll(pairs)
        edges = edges.unionAll(links(pairs))
        roots = components(edges)
    last = stage_table(_block_links(_mixed(crowded, roots, ROUNDS), roots, docs, size, percent), "links")
    if last.limit(1).count():
        roots = components(edges.unionAll(last))
    final = classes.join(roots, classes["rep"] == roots["node"], "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("root", "rep").alias("component"))
    joined = signed.join(final, (signed["s1"] == final["c1"]) & (signed["s2"] == final["c2"]) & (signed["n_shingles"] > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _mixed(crowded: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Members of buckets with several components, with the bucket's largest component and a member of it (another each turn)."""
    members = stage_table(crowded.join(roots, F.col("doc_id") == F.col("node"), "left").select("band", "key", "doc_id", F.coalesce("root", "doc_id").alias("comp")), "members")
    lot = F.xxhash64("doc_id", F.lit(turn))
    sizes = members.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.min(lot).alias("lot"))
    mixed = sizes.groupBy("band", "key").agg(F.count("*").alias("comps"), F.max_by("comp", "n").alias("major"), F.max_by("lot", "n").alias("lot")).filter(F.col("comps") > 1).drop("comps")
    pivots = spread_join(members, mixed, ["band", "key"], "doc_id").withColumn("chosen", (F.col("comp") == F.col("major")) & (lot == F.col("lot")))
    return stage_table(pivots.drop("lot"), "mixed")


def _pivot_pairs(inside: DataFrame) -> DataFrame:
    """Members outside their bucket's largest component with its chosen member."""
    chosen = inside.filter("chosen").select("band", "key", F.col("doc_id").alias("x"))
    others = inside.filter(F.col("comp") != F.col("major")).select("band", "key", F.col("doc_id").alias("y"))
    return spread_join(others, chosen, ["band", "key"], "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _block_links(inside: DataFrame, roots: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of documents outside their buckets' largest components with those components' documents and with one another.

    The documents outside are a set of queries against each component, in blocks of at
    most about BLOCK by BLOCK documents, each in a task: shingle by shingle, so that
    no pair becomes a row. A query gives one link for each component that it meets.
    """
    wanted = stage_table(inside.filter(F.col("comp") != F.col("major")).select(F.col("doc_id").alias("id"), "comp", F.col("major").alias("m")).distinct(), "wanted")
    majors = wanted.select("m").distinct()
    grown = roots.join(majors, F.col("root") == F.col("m"), "left_semi").select(F.col("node").alias("id"), F.col("root").alias("comp"), F.col("root").alias("m"))
    members = grown.unionAll(majors.select(F.col("m").alias("id"), F.col("m").alias("comp"), "m")).unionAll(wanted).distinct()
    blocks = lambda df, name: df.groupBy("m").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    shape = stage_table(blocks(members, "nb").join(blocks(wanted, "ns"), "m"), "shape")
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = members.join(shape, "m").select("id", "comp", "m", lot("nb").alias("mb"), upto("ns").alias("sb"), F.lit(False).alias("query"))
    sides = stage_table(sides.unionAll(wanted.join(shape, "m").select("id", "comp", "m", upto("nb").alias("mb"), lot("ns").alias("sb"), F.lit(True).alias("query"))), "sides")
    texts = _needed(docs, sides.select("id")).withColumnRenamed("doc_id", "tid")

    def compare(table: pa.Table) -> pa.Table:
        found = _compare(table.combine_chunks(), size, percent)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return sides.join(texts, F.col("id") == F.col("tid")).drop("tid").groupBy("m", "mb", "sb").applyInArrow(compare, "a long, b long")


def _compare(table: pa.Table, size: int, percent: int) -> tuple[list[int], list[int]]:
    """(query, member) ids of similar texts of a block, one for each query and component."""
    is_query = table["query"].to_numpy()
    ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
    column = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    found, owner = _sets(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, size)
    n = np.bincount(owner, minlength=len(ids))
    mine = ~is_query[owner]
    order = np.argsort(found[mine], kind="stable")
    keys, holder = found[mine][order], owner[mine][order]
    ends = np.cumsum(n)
    out: tuple[list[int], list[int]] = ([], [])
    for q in np.flatnonzero(is_query):
        h = found[ends[q] - n[q] : ends[q]]
        lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
        spans = hi - lo
        at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(lo, spans)
        both = np.bincount(holder[at], minlength=len(ids))
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (n[q] + n - both)) & (comps != comps[q]))
        for k in np.unique(comps[hit], return_index=True)[1]:
            out[0].append(int(ids[q]))
            out[1].append(int(ids[hit[k]]))
    return out
