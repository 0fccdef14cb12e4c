"""The ledger of secrets: what is scanned, long texts, and redaction by spans."""

from __future__ import annotations

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import tables  # noqa: E402

from suspectra.llm import queries_native, secrets  # noqa: E402


def _plain(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans by Python's own patterns."""
    out = []
    for rank, r in enumerate(secrets.RULES[:3]):
        out += [(m.start(), rank, m.end(), r.kind) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_second_version_scans_only_unseen_blobs(spark):
    """A version adds rows to the ledger for new texts only, and a new version of a rule is tried alone."""
    first = spark.createDataFrame([(k, f"token = abcdefgh{k % 5}x" if k % 2 else f"nothing {k % 7}") for k in range(100)], "doc_id long, text string")
    ledger = secrets.Ledger.temporary(spark)
    ledger.update(first)
    n = ledger.read().count()
    assert n == first.select("text").distinct().count()
    again = first.withColumn("doc_id", first["doc_id"] + 1000)
    paths = ledger.update(again)
    assert ledger.read().count() == n and paths.count() == 100
    more = again.unionAll(spark.createDataFrame([(5000, "password: swordfish99"), (5001, "nothing 1")], "doc_id long, text string"))
    paths = ledger.update(more)
    assert ledger.read().count() == n + 1
    found = {r["path"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in ledger.findings(paths).collect()}
    assert len(found) == 102 and found[5000] == [("assign", 0, 21)] and found[5001] == [] and found[1001] == [("assign", 0, 18)]
    newer = tuple(secrets.replace(r, version=2) if r.kind == "hex" else r for r in secrets.RULES)
    ledger.update(more, rules=newer)
    done = ledger.read().filter("array_contains(done, named_struct('rule', 'hex', 'version', 2))")
    assert done.count() == n + 1 and done.filter("size(done) <> 1").count() == 0


def test_no_pattern_is_tried_on_a_path(spark, sf):
    """The plan of the query's result reads the ledger and narrow paths; texts and patterns were the ledger's."""
    plan = queries_native.op1_secret_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "rlike" not in plan.lower() and "regexp" not in plan.lower() and "text#" not in plan


def test_spans_of_very_long_texts(spark):
    """A dump of hexadecimal lines and a long list of tokens: hundreds of thousands of matches in one text."""
    rng = random.Random(2)
    line = "".join(rng.choice("0123456789abcdef") for _ in range(64))
    texts = ["\n".join([line] * 60_000), "x " + "token=abcdefgh12 " * 40_000, "\N{GRINNING FACE} token=abcdefgh12 " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["path"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan(docs, rules=secrets.WHOLE)[0].collect()}
    assert len(found[0]) == 60_000 and found[0][-1] == ("hex", 65 * 59_999, 65 * 59_999 + 64)
    assert len(found[1]) == 40_000 and found[2] == _plain(texts[2]) and found[1] == _plain(texts[1])
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[0] == "\n".join(["[REDACTED]"] * 60_000) and clean[2] == "\N{GRINNING FACE} [REDACTED] " * 3
    assert clean[1] == "x " + "[REDACTED] " * 40_000


def test_redaction_follows_the_spans(spark):
    """Overlapping spans go under one mark; the rest of the text is as it was, across blocks, too."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = tables.sentence(rng, rng.randint(5, 4000)).split()
        for _ in range(rng.randint(0, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(["token=Bearer_" + "a" * 30, "secret: " + "0123456789abcdef" * 3, "AKIA" + "A1" * 10, "é中" * 9]))
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["path"]: [(x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan(docs, rules=secrets.WHOLE)[0].collect()}
    for r in secrets.redact(docs).collect():
        text, out, at = rows[r["doc_id"]][1], "", 0
        for a, b in spans[r["doc_id"]]:
            if a >= at:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        assert r["text"] == out + text[at:]


@pytest.mark.parametrize("text", [r["text"] or "" for r in tables.documents() if "oken" in (r["text"] or "") or "AKIA" in (r["text"] or "")])
def test_tight_patterns_match_as_the_loose_ones(text):
    for loose, tight in zip(secrets.RULES, secrets.WHOLE, strict=True):
        if loose.kind in ("access", "hex"):
            spans = lambda r: [m.span() for m in re.finditer(r.pattern, text) if len(m[0]) >= r.least]
            assert spans(loose) == spans(tight)
