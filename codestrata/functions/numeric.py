"""Rounding and coercion.

Two rounding rules occur in the results to match, and they differ on ties:

* ``round_scaled``: scale, round half to even, unscale - what array libraries do.
* ``round_exact``: round the exact binary value of the double - what a scalar
  ``round(x, digits)`` does in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplying by 2**27 + 1 splits a double into two halves of at most 26 bits each.
_SPLITTER = float(2**27 + 1)


def round_scaled(value: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def round_exact(value: Column, digits: int) -> Column:
    """Correctly rounded decimal places of the stored double.

    ``value * scale`` is itself rounded, which can land on a tie that the exact
    product is not on. The low-order error of that product (exact, because the
    halves and the scale have few bits) tells which side the true value is on.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    spread = value * F.lit(_SPLITTER)
    high = spread - (spread - value)
    error = (high * scale - product) + (value - high) * scale
    on_tie = (product - F.floor(product)) == 0.5
    nearest = (
        F.when(on_tie & (error > 0), F.ceil(product).cast("double"))
        .when(on_tie & (error < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return nearest / scale


def ratio_or_zero(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` rounded, or 0.0 when there is nothing to divide by."""
    quotient = numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    return F.coalesce(round_exact(quotient, digits), F.lit(0.0))


def decimal_mean(value: Column) -> Column:
    """Mean that does not depend on the order of summation.

    Values are summed as decimals of ten places, so equal inputs give the same mean in any
    partitioning. A value that is too large for one (from 10**28 on), and a sum that is, is an
    error: nothing is left out of a mean.
    """
    number = value.cast("double")
    too_large = F.raise_error(F.lit("a value of a mean is 10**28 or more")).cast("decimal(38,10)")
    exact = F.when(F.abs(number) >= F.lit(1e28), too_large).otherwise(
        value.try_cast("decimal(38,10)"))
    return F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))


def coerce_number(value: Column) -> Column:
    """Numeric value of a loosely typed column, NULL when it is not a finite number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def coerce_count(value: Column) -> Column:
    """Digit-only text as a long; anything else (a binary file's ``-``) is NULL."""
    digits = F.translate(value, "0123456789", "") == ""
    return F.when(digits & (value != ""), value.try_cast("long"))
