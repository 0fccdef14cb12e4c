"""Predicates that name a mistake: original and erroneous numeric strings. String functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import both_numbers, number


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _drops_one(longer: Column, shorter: Column) -> Column:
    """Whether ``shorter`` is ``longer`` less one character."""
    n = F.char_length(longer)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.substring(longer, F.lit(1), k - 1), F.substring(longer, k + 1, n)))
    return (n == F.char_length(shorter) + 1) & F.array_contains(cuts, shorter)


def misplaced_decimal(o: Column, e: Column) -> Column:
    point = lambda x: F.instr(x, ".")
    return both_numbers(o, e) & (_digits(o) == _digits(e)) & (point(o) != point(e)) & (point(o) > 0) & (point(e) > 0)


def decimal_omission(o: Column, e: Column) -> Column:
    return both_numbers(o, e) & (F.instr(o, ".") > 0) & (F.replace(o, F.lit("."), F.lit("")) == e)


def sign_omission(o: Column, e: Column) -> Column:
    return both_numbers(o, e) & o.rlike("^[+-]") & (F.substring(o, F.lit(2), F.char_length(o)) == e)


def sign_error(o: Column, e: Column) -> Column:
    return both_numbers(o, e) & (number(o) == -number(e)) & (number(o) != 0)


def digit_repeat(o: Column, e: Column) -> Column:
    """A character is typed twice where it belongs once."""
    n = F.char_length(o)
    doubled = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.substring(o, F.lit(1), k), F.substring(o, k, n)))
    return both_numbers(o, e) & (n > 0) & F.array_contains(doubled, e)


def extra_digit(o: Column, e: Column) -> Column:
    return both_numbers(o, e) & _drops_one(e, o)


def digit_omission(o: Column, e: Column) -> Column:
    return both_numbers(o, e) & _drops_one(o, e) & ~decimal_omission(o, e) & ~sign_omission(o, e)


def wrong_digit(o: Column, e: Column) -> Column:
    n = F.char_length(o)
    apart = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(o, k, F.lit(1)) != F.substring(e, k, F.lit(1))))
    return both_numbers(o, e) & (n == F.char_length(e)) & (apart == 1)


def blank(o: Column, e: Column) -> Column:
    return (F.trim(o) != "") & (F.trim(F.coalesce(e, F.lit(""))) == "")


def digit_transposition(o: Column, e: Column) -> Column:
    n = F.char_length(o)
    swapped = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(F.substring(o, F.lit(1), k - 1), F.substring(o, k + 1, F.lit(1)), F.substring(o, k, F.lit(1)), F.substring(o, k + 2, n)))
    return both_numbers(o, e) & (n == F.char_length(e)) & (o != e) & F.array_contains(swapped, e)


ALL = {f.__name__: f for f in (misplaced_decimal, decimal_omission, sign_omission, sign_error, digit_repeat, extra_digit, wrong_digit, digit_omission, blank, digit_transposition)}
