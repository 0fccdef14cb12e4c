"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words. Words are picked by their association
with the label over a bounded sample of labelled rows. Each labelled text that has
an identity term gets counterfactuals, the text with the term swapped for each other
one of its group, and the mean squared change of the score is a penalty, so that a
neutral mention of a group does not raise a text's score. A term that the model
doesn't know has the weight 0.

Defined cases: null and empty texts get the score of a text without known words; a
null id is scored and never learnt from; repeated labels of an id count as toxic if
any is, and of repeated texts of an id the one with the least hash is learnt from; with labels of one kind only, or none, every score is their smoothed share;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import stage_table

#: The bounds of the fit: labelled rows (the smallest by hash of the id) and words.
LABELLED = 20_000
WORDS = 1_000
LEAST_ROWS = 5
#: Identity terms that a table may have.
TERMS = 10_000
L2 = 0.1
SWAP = 10.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Identity terms; a term is swapped for each other one of its line.
IDENTITY = """
women men girls boys
woman man girl boy
female male
gay lesbian straight bisexual queer
transgender cisgender
black white asian latino latina african european
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
immigrant citizen refugee foreigner
immigrants citizens refugees foreigners
old young elderly teenage
blind deaf disabled
mexican chinese american german french spanish indian arab
rich poor
"""
U64 = np.uint64


def word_hashes(terms: list[str]) -> np.ndarray:
    raw = strings_of(terms)
    return np.concatenate([tk.words(r, o, tk.LOWER, LETTERS).hashes for _, r, o in tk.slices(raw)]) if terms else np.zeros(0, U64)


def strings_of(terms: list[str]) -> pa.Array:
    return tk.strings(pa.array(terms, pa.string()))


def groups_of(table: DataFrame, most: int = TERMS) -> str:
    """IDENTITY's form of a table of terms (group, term) of one's own; more than ``most`` terms are an error."""
    rows = table.select("group", "term").filter("group IS NOT NULL AND term IS NOT NULL").distinct().orderBy("group", "term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"there are more than {most} identity terms")
    lines: dict = {}
    for r in rows:
        lines.setdefault(r["group"], []).append(r["term"])
    return "\n".join(" ".join(line) for line in lines.values())


def swaps(groups: str = IDENTITY) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for line in groups.strip().splitlines():
        h = list(dict.fromkeys(int(x) for x in word_hashes(line.split())))
        out |= {a: [b for b in h if b != a] for a in h}
    return out


@dataclass
class Model:
    """Words by hash (sorted), their weights and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        parts = []
        for _, raw, offsets in tk.slices(tk.strings(column)):
            w = tk.words(raw, offsets, tk.LOWER, LETTERS)
            z = np.full(len(offsets) - 1, self.bias)
            if len(self.words) and len(w.hashes):
                at = np.minimum(np.searchsorted(self.words, w.hashes), len(self.words) - 1)
                known = np.flatnonzero(self.words[at] == w.hashes)
                pairs = np.unique(w.text[known] * len(self.words) + at[known])
                np.add.at(z, pairs // len(self.words), self.weights[pairs % len(self.words)])
            parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(rows: list[np.ndarray], toxic: np.ndarray, vocabulary: np.ndarray, pairs: dict[int, list[int]], l2: float = L2, swap: float = SWAP, steps: int = 400) -> Model:
    """rows: each text's known words. Gradient descent with momentum on the mean log loss plus both penalties."""
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(vocabulary) == 0 or toxic.min(initial=1) == toxic.max(initial=0):
        return Model(np.zeros(0, U64), np.zeros(0), bias)
    n, v = len(rows), len(vocabulary)
    at = np.concatenate([np.searchsorted(vocabulary, r) for r in rows]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    # Counterfactuals: the change of a text's score is the difference of two weights; place v is an unknown word's weight, 0.
    known = {int(h): k for k, h in enumerate(vocabulary)}
    n_texts = np.bincount(at, minlength=v)
    changes = [(k, known.get(other, v), n_texts[k] / len(pairs[h])) for h, k in known.items() for other in pairs.get(h, ())]
    source, target, share_of = (np.array(c, d) for c, d in zip(zip(*changes, strict=True), (np.int64, np.int64, float), strict=True)) if changes else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    w, b = np.zeros(v), bias
    vw, vb = np.zeros(v), 0.0
    # Step size from each word's own curvature.
    curve = np.bincount(at, minlength=v) / n / 4 + l2 / n + 4 * swap * (np.bincount(source, share_of, v) + np.bincount(target, share_of, v + 1)[:v]) / n
    for _ in range(steps):
        z = b + np.bincount(row, w[at], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        grad = np.bincount(at, err[row], minlength=v) / n + l2 * w / n
        if len(source):
            d = share_of * (w[source] - np.append(w, 0.0)[target])
            grad += 2 * swap / n * (np.bincount(source, d, minlength=v) - np.bincount(target, d, minlength=v + 1)[:v])
        vw = 0.8 * vw - 0.1 * grad / curve
        vb = 0.8 * vb - 0.4 * err.mean()
        w, b = w + vw, b + vb
    return Model(vocabulary, w, b)


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, words: int = WORDS, groups: str = IDENTITY, swap: float = SWAP) -> Model:
    """groups: IDENTITY or ``groups_of`` a table. swap: the penalty's strength; 0 for none."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The bound holds before texts are read: a sample of labels, then their texts.
    few = stage_table(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("id"), "toxic"), "labelled")
    # At most ``bound`` rows of two numbers: the broadcast has a fixed size, and texts stay where they are.
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.coalesce("text", F.lit("")))).alias("text"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in tk.slices(tk.strings(batch.column(2))):
                w = tk.words(raw, offsets, tk.LOWER, LETTERS)
                h, owner = tk.distinct(w.hashes, w.text)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))]).astype(np.int32)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["id", "toxic", "words"])

    bags = stage_table(chosen.mapInArrow(present, "id long, toxic int, words array<long>"), "bags")
    n, bad = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (bad + 0.5) / (n + 1)
    pairs = swaps(groups)
    terms = [int(np.array([h], U64).view(np.int64)[0]) for h in pairs]
    each = bags.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter(F.col("n") >= LEAST_ROWS)
    z = F.abs(F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    picked = [r["w"] for r in each.orderBy(z.desc(), "w").limit(words).collect()]
    seen = [r["w"] for r in each.filter(F.col("w").isin(terms)).collect()] if terms else []
    vocabulary = np.unique(np.array([*picked, *seen], np.int64).view(U64))
    signed = vocabulary.view(np.int64)
    known = bags.select("id", "toxic", F.array_intersect("words", F.array(*[F.lit(int(x)) for x in signed]).cast("array<long>")).alias("words")) if len(signed) else bags.select("id", "toxic", F.array().cast("array<long>").alias("words"))
    got = sorted((r["id"], r["toxic"], r["words"]) for r in known.collect())
    rows = [np.array(ws, np.int64).view(U64) for _, _, ws in got]
    return fit(rows, np.array([float(t) for _, t, _ in got]), vocabulary, pairs, swap=swap)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
