"""Golden values of alignment, transpositions, typos and generated errors."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from suspectra.functions import align
from suspectra.functions.errors import ErrorModel, pick, rng_for


def test_common_strings():
    assert "Hello" in align.subsequences("Hello", "Helloo")


def test_all_alignments():
    found = align.alignments("Hello", "Heellloo")
    assert len(found) == 12
    assert ((0, 0), (1, 2), (2, 4), (3, 5), (4, 7)) in found and ((0, 0), (1, 2), (2, 4), (3, 5), (4, 6)) in found
    assert len(align.alignments("abc", "abcc")) == 2


def test_left_aligned():
    assert align.left_aligned("abc", "abcc") == ((0, 0), (1, 1), (2, 2))
    assert align.left_aligned("aaab", "bzzzaaa") == ((0, 4), (1, 5), (2, 6))


def test_added_and_missing():
    assert align.added("abcc", align.left_aligned("abc", "abcc")) == [3]
    assert align.missing("abc", align.left_aligned("abc", "bc")) == [0]


def fixed(x, y, pairs=None):
    pairs = pairs or align.left_aligned(x, y)
    return align.fix_transpositions(pairs, align.added(y, pairs), align.missing(x, pairs), x, y)


@pytest.mark.parametrize(
    ("x", "y", "pairs", "text", "aligned", "extra", "deltas"),
    [
        ("aaabq", "bbzzzaaaq", None, "bzzzaaabq", ((0, 4), (1, 5), (2, 6), (3, 7), (4, 8)), [0, 1, 2, 3], [-3]),
        ("baaaq", "zzzaaabbq", None, "bzzzaaabq", ((0, 0), (1, 4), (2, 5), (3, 6), (4, 8)), [1, 2, 3, 7], [3]),
        ("acc", "cca", None, "acc", ((0, 0), (1, 1), (2, 2)), [], [2]),
        ("acc", "cac", ((0, 1), (2, 2)), "acc", ((0, 0), (1, 1), (2, 2)), [], [-1]),
        ("cac", "acc", ((0, 1), (2, 2)), "cac", ((0, 0), (1, 1), (2, 2)), [], [-1]),
    ],
)
def test_transpositions(x, y, pairs, text, aligned, extra, deltas):
    out = fixed(x, y, pairs)
    assert out == (text, aligned, extra, [], deltas)


def typos(x, y):
    pairs = align.left_aligned(x, y)
    text, pairs2, *_ = fixed(x, y)
    return align.typos(pairs2, x, text)


def test_empty_entry():
    assert align.missing("0", align.left_aligned("0", "")) == [0]
    assert align.typos((), "0", "") == [(None, "")]


def test_added_at_start():
    pairs = align.left_aligned("abc", "ddabc")
    assert align.missing("abc", pairs) == [] and align.added("ddabc", pairs) == [0, 1]
    assert align.typos(pairs, "abc", "ddabc") == [(None, "dd"), ("a", "a"), ("b", "b"), ("c", "c")]


def test_typo_keys():
    found = typos("abcd", "zdcd")
    assert {c for c, _ in found} == {None, "a", "b", "c", "d"}
    assert set("".join(s for _, s in found)) <= {"z", "d", "c"}


def test_typo_strings():
    found = dict(typos("Testing", "Tesying"))
    assert found[None] == "" and (found["s"], found["t"]) in {("sy", ""), ("s", "y")}
    assert all(found[c] == c for c in "Teing")


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_alignments_are_valid(x, y):
    found = align.alignments(x, y)
    assert align.one_alignment(x, y) in found
    for w in found:
        assert len(w) == align.lcs_length(x, y) and all(x[i] == y[j] for i, j in w)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(w, w[1:], strict=False))
    align.process(x, y)


def test_cap_falls_back_to_one():
    assert len(align.alignments("ab" * 8, "ba" * 8, cap=10)) == 1


def test_error_rate_of_training():
    """Trained on mostly clean retypings, the model's rate of wrong typings isn't above the observed one."""
    rng, right, wrong = random.Random(1), 0, 0
    for _ in range(2000):
        y = "Testing" if rng.random() < 0.95 else rng.choice(["Tesying", "eTTsting", "Tessting"])
        found, _, _, n = align.process("Testing", y)
        wrong += n
        right += len(found) - n
    assert 0 < wrong / (right + wrong) < 0.05


MODEL = {("t", "y"): 1, ("t", "t"): 0, ("T", "TT"): 1, ("e", "e"): 1, ("s", "s"): 1}


def test_typoize():
    assert ErrorModel(MODEL, {}).typed([None, *"Testing", None], -1, rng_for(1)) == "TTesying"


@pytest.mark.parametrize(("moves", "out"), [({3: 10}, "dbca"), ({1: 10}, "bcda"), ({10: 10, -10: 10, 0: 1}, "abcd")])
def test_transpose(moves, out):
    assert "".join(ErrorModel({}, moves).transposed(list("abcd"), -1, rng_for(1))) == out


def test_errors_change_the_text():
    m = ErrorModel(MODEL | {("t", "t"): 9, ("T", "T"): 5}, {0: 8, 1: 2})
    for k in range(50):
        assert m.error("Testing", rng_for(k)) != "Testing"
    assert ErrorModel({}, {}).error("same", rng_for(1)) == "same"
    assert m.error("Testing", rng_for(7)) == m.error("Testing", rng_for(7))


def test_subtle_errors_are_small():
    m = ErrorModel({(str(d), str(e)): 1 for d in range(10) for e in range(10)}, {0: 1})
    for k in range(20):
        out = m.subtle_error("1234", rng_for(k))
        assert out == "1234" or math.log10(abs(float(out) - 1234) / 1234) < 0


def test_pick_follows_weights():
    rng = random.Random(0)
    seen = [pick({"a": 1, "b": 3, "c": 0}, rng) for _ in range(4000)]
    assert "c" not in seen and 0.7 < seen.count("b") / 4000 < 0.8
