"""References in formula text: A1 cells and ranges, with or without a sheet. String functions only.

Supported: ``A1``, ``$A$1``, ``A1:B3``, ``Sheet!A1``, ``'My sheet'!A1:B3``, in any
expression of functions and arithmetic. Names followed by ``(`` are functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET = r"(?:'[^']+'!|[A-Za-z_][A-Za-z0-9_]*!)?"
CELL = r"\$?[A-Z]{1,3}\$?[0-9]{1,7}"
RANGE = SHEET + CELL + ":" + CELL
#: A single reference: not part of a longer name, not a function.
SINGLE = r"(?:^|[^A-Za-z0-9_$'!:])(" + SHEET + CELL + r")(?![A-Za-z0-9_(!:])"
FUNCTION = r"([A-Z][A-Z0-9.]*)\("


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters."""
    rest = number - 1
    third = F.floor((rest - 702) / 676)
    second = F.floor((rest - 26) / 26) % 26
    letter = lambda k: F.char((F.lit(65) + k).cast("int"))
    return F.concat(F.when(rest >= 702, letter(third)).otherwise(""), F.when(rest >= 26, letter(second)).otherwise(""), letter(rest % 26))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def _corner(ref: Column) -> tuple[Column, Column]:
    bare = F.replace(ref, F.lit("$"), F.lit(""))
    return F.regexp_extract(bare, "([0-9]+)$", 1).cast("int"), column_number(F.regexp_extract(bare, "^([A-Z]+)", 1))


def _sheet(ref: Column, default: Column) -> Column:
    named = F.regexp_extract(ref, r"^(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_]*))!", 0)
    return F.when(named != "", F.regexp_replace(named, r"^'|'?!$", "")).otherwise(default)


def ranges(formulas: DataFrame) -> DataFrame:
    """formulas: formula_id, worksheet, expr. Distinct formula_id, worksheet, top, left, bottom, right of ranges; corners in either order."""
    each = formulas.select("formula_id", "worksheet", F.explode(F.regexp_extract_all("expr", F.lit(RANGE), F.lit(0))).alias("ref"))
    sheet = _sheet(F.col("ref"), F.col("worksheet"))
    body = F.regexp_replace("ref", "^.*!", "")
    (r1, c1), (r2, c2) = _corner(F.substring_index(body, ":", 1)), _corner(F.substring_index(body, ":", -1))
    return each.select("formula_id", sheet.alias("worksheet"), F.least(r1, r2).alias("top"), F.least(c1, c2).alias("left"), F.greatest(r1, r2).alias("bottom"), F.greatest(c1, c2).alias("right")).distinct()


def singles(formulas: DataFrame) -> DataFrame:
    """formula_id, worksheet, row, col of single-cell references."""
    without = F.regexp_replace("expr", RANGE, " ")
    each = formulas.select("formula_id", "worksheet", F.explode(F.regexp_extract_all(without, F.lit(SINGLE), F.lit(1))).alias("ref"))
    row, col = _corner(F.regexp_replace("ref", "^.*!", ""))
    return each.select("formula_id", _sheet(F.col("ref"), F.col("worksheet")).alias("worksheet"), row.alias("row"), col.alias("col")).distinct()


def functions(formulas: DataFrame) -> DataFrame:
    return formulas.select("formula_id", F.explode(F.array_distinct(F.regexp_extract_all("expr", F.lit(FUNCTION), F.lit(1)))).alias("function"))
