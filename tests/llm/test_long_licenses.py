"""A long list of notices in one text."""

from __future__ import annotations

from suspectra.llm import licenses


def test_many_notices_in_one_text(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, "All rights reserved. Some other words. CC BY! " * n), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.summary(docs).collect()}
    r = got[1]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (8 * n, 2 * n, 0, 8 * n - 2, "cc-by,reserved")
    assert got[2]["n_base"] == got[3]["n_base"] == 0 and got[3]["n_words"] == 0
