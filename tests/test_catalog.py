"""Every query with SQL against DuckDB; those without run and are checked by their own tests."""

from __future__ import annotations

import pytest
from compare import differences

from suspectra.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert differences(df, SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"simulate_audit", "simulation_report"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_injected_errors_are_flagged(spark):
    scores = QUERIES["impact_numeric_scores"](spark, "/root/testdata/sf0.01").filter("score > 0").collect()
    assert scores and all(r["cell_id"] % 97 == 0 for r in scores)


def test_audit(spark):
    """An audit goes on until nothing is flagged: every outlier of the corrected cells is inspected."""
    row = QUERIES["simulation_report"](spark, "/root/testdata/sf0.01").filter("analysis_type = 'normal_all'").first()
    assert row["number_of_errors"] == 3 and row["true_positives"] == 3 and row["false_negatives"] == 0
    assert row["effort"] == row["true_positives"] + row["false_positives"] and row["average_precision"] > 0.9
    assert row["total_relative_error"] == 0 < row["initial_total_relative_error"] and row["num_max_out_diff_mag"] > 0
