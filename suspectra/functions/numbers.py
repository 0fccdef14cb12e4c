"""Scalar expressions: number tests, fixed-point truncation, relative errors, the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: one pattern for every engine, as their own parsers differ.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number(raw: Column) -> Column:
    """The value of a numeric string, else null. Surrounding blanks are allowed."""
    bare = F.trim(raw)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def both_numbers(x: Column, y: Column) -> Column:
    return number(x).isNotNull() & number(y).isNotNull()


def cut4(x: Column) -> Column:
    """Truncation to four decimals, towards zero."""
    scaled = x * 10000
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / 10000.0


def at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def magnitude_change(erroneous: Column, correct: Column) -> Column:
    """Orders of magnitude of the relative error of numbers; 0 if equal."""
    return F.when(erroneous == correct, F.lit(0.0)).otherwise(F.log10(F.abs(erroneous - correct) / F.abs(correct + 1e-12)))


def categorical_change(erroneous: Column, correct: Column) -> Column:
    return F.when(erroneous.eqNullSafe(correct), F.lit(0.0)).otherwise(F.lit(1.0))


def absolute_error(x: Column, y: Column) -> Column:
    """Absolute difference of two numeric strings; else 0 or 1."""
    return F.when(both_numbers(x, y), F.abs(number(x) - number(y))).otherwise(categorical_change(x, y))


#: Coefficients of the rational approximation of erf, formula 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def erfc(x: Column) -> Column:
    return 1.0 - erf(x)


def phi(z: Column) -> Column:
    """Normal distribution function."""
    return 0.5 * (1.0 + erf(z / F.sqrt(F.lit(2.0))))
