"""Command line: score the cells of a table, or audit it with known errors.

    python -m suspectra analyze CELLS SCORES [--boots N] [--sensitivity 5.0] [--formula SUM]
    python -m suspectra workbook WORKBOOK SCORES [--boots N] [--sensitivity 5.0] [--all-outputs] [--unweighted]
    python -m suspectra audit CELLS ERRORS REPORT [--boots N] [--rounds N]

CELLS: Parquet with range_id, idx, cell_id, v, weight. WORKBOOK: Parquet with cell_id, worksheet, row, col, raw. ERRORS: Parquet with cell_id, value.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import cutoff, experiments, inference
from .sources import store


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["analyze", "workbook", "audit"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--boots", type=int, default=2719)
    parser.add_argument("--sensitivity", default="5.0", help="per cent")
    parser.add_argument("--formula", default="SUM")
    parser.add_argument("--rounds", type=int, default=None, help="cells to inspect; else until nothing is flagged")
    parser.add_argument("--all-outputs", action="store_true")
    parser.add_argument("--unweighted", action="store_true")
    found = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    significance = cutoff.significance_of(found.sensitivity)
    cells = spark.read.parquet(found.paths[0])
    if found.command == "analyze":
        scores = inference.merge(inference.analyze(cells, found.formula, found.boots, significance))
        cutoff.above_significance(scores, significance).write.mode("overwrite").parquet(found.paths[1])
    elif found.command == "workbook":
        scores = inference.merge(inference.analyze_workbook(cells, found.boots, significance, weighted=not found.unweighted, all_outputs=found.all_outputs))
        cutoff.above_significance(scores, significance).write.mode("overwrite").parquet(found.paths[1])
    else:
        report = experiments.run(cells, spark.read.parquet(found.paths[1]), found.boots, significance, found.rounds)
        store.append_csv(report, found.paths[2], store.RESULT)


if __name__ == "__main__":
    main()
