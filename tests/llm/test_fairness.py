"""The counterfactual penalty on the corpus: neutral mentions of a group, held out."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suspectra.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.1"


def mentioned(docs, labels):
    """Texts with mentions: 'zorbian' in most toxic texts and few others, 'quellish' in some of either kind."""
    lot = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(100))
    marked = docs.join(F.broadcast(labels.select("doc_id", "toxic")), "doc_id")
    often = lot(1) < F.when(F.col("toxic") == 1, 60).otherwise(4)
    other = lot(2) < 15
    text = F.concat("text", F.when(often, " among zorbian neighbours").otherwise(""), F.when(other, " among quellish neighbours").otherwise(""))
    return marked.select("doc_id", text.alias("text"), "toxic", often.alias("often"))


def test_fewer_false_positives_on_neutral_mentions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    table = mentioned(docs, labels)
    groups = toxicity.groups_of(spark.createDataFrame([("people", "zorbian"), ("people", "quellish"), ("people", "zorbian"), (None, "x")], "group string, term string"))
    assert groups == "quellish zorbian"
    rates = {}
    for swap in (0.0, toxicity.SWAP):
        model = toxicity.train(table.select("doc_id", "text"), labels, groups=groups, swap=swap)
        got = toxicity.score(table.select("doc_id", "text"), model).join(table.select("doc_id", "toxic", "often"), "doc_id").filter("held_out").toPandas()
        neutral = got[(got.toxic == 0) & got.often]
        rates[swap] = (neutral.predicted.mean(), neutral.score.mean(), (got[(got.toxic == 0) & ~got.often].predicted).mean(), len(neutral))
        assert rates[swap][3] > 15
        assert got[got.toxic == 1].score.mean() > 5 * got[got.toxic == 0].score.mean()
    free, fair = rates[0.0], rates[toxicity.SWAP]
    assert fair[1] < 0.7 * free[1] and fair[0] <= free[0] and fair[2] < 0.02


def test_repeated_ids_give_one_model(spark):
    rows = [(k % 40, f"{'idiot' if k % 4 == 0 else 'friend'} word{k % 3} and more") for k in range(160)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    scores = []
    for order in (rows, rows[::-1]):
        model = toxicity.train(spark.createDataFrame(order, "doc_id long, text string").repartition(5), labels)
        scores.append((model.words.tolist(), model.weights.tolist(), model.bias))
    assert scores[0] == scores[1]


def test_too_many_terms(spark):
    with pytest.raises(ValueError, match="terms"):
        toxicity.groups_of(spark.createDataFrame([("g", f"t{k}") for k in range(9)], "group string, term string"), 8)
