"""The queries of the data-debugging operators, by name, and their SQL."""

from __future__ import annotations

from . import baselines, graphs, impact, retyping, workbooks


def queries() -> dict:
    return impact.QUERIES | baselines.QUERIES | graphs.QUERIES | retyping.QUERIES | workbooks.QUERIES


def oracle_sql() -> dict[str, str]:
    return impact.SQL | baselines.SQL | graphs.SQL | retyping.SQL | workbooks.SQL
