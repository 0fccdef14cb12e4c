"""Ranges of a workbook by blocks against a row for each draw."""

from __future__ import annotations

import random

from compare import plain

from suspectra.operators import blocks, inference


def test_ranges_by_blocks(spark, monkeypatch):
    """Blanks, parts of a range, a text, cells that no resample leaves out: the same scores, and no row for a draw of a range of numbers."""
    rng = random.Random(3)
    rows = [(r, 1, str(100 + rng.randint(0, 9)) if r != 4 else "9000") for r in range(1, 9)] + [(r, 2, "" if r == 2 else str(rng.randint(0, 9) / 4)) for r in range(1, 6)] + [(r, 3, "x" if r == 1 else str(r)) for r in range(1, 4)]
    rows += [(1, 5, "=SUM(A1:A8)+MEDIAN(A1:A3)"), (2, 5, '=IF(E1>5000,"high","low")'), (3, 5, "=AVERAGE(B1:B5)+COUNTA(B1:B9)*10"), (4, 5, "=SUM(C1:C3)+E3"), (5, 5, "=MAX(A1:A8)-MIN(B1:B5)")]
    cells = spark.createDataFrame([(r * 100 + c, "S", r, c, raw) for r, c, raw in rows], "cell_id long, worksheet string, row int, col int, raw string")
    dealt = []
    whole = inference.draws
    monkeypatch.setattr(inference, "draws", lambda placed, *args: dealt.append(placed.count()) or whole(placed, *args))
    answer = lambda: sorted((tuple(map(plain, r)) for r in inference.analyze_workbook(cells, 3).collect()), key=repr)
    got = answer()
    every = blocks.slow
    monkeypatch.setattr(blocks, "slow", lambda p, known, placed: (placed.select("range_id").distinct(), every(p, known, placed)[1]))
    assert got == answer() and any(r[6] for r in got) and any(r[2] is None for r in got)
    # A1:A3 is read by a sum over more cells, and C1:C3 has a text.
    assert dealt == [6, 24]


def test_flagged_of_a_workbook(spark, sf, monkeypatch):
    """The query's ranges are resampled by blocks: no row for a draw."""
    from suspectra.plans import workbooks

    dealt = []
    whole = inference.draws
    monkeypatch.setattr(inference, "draws", lambda placed, *args: dealt.append(placed.count()) or whole(placed, *args))
    assert workbooks.workbook_flagged(spark, sf).columns == ["cell_id", "score"] and dealt == [0]
