"""Arithmetic that gives the same answer whatever the row order.

Sums and averages over groups run on decimals, because a floating sum depends on the
order in which tasks deliver their rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(value: Column, digits: int) -> Column:
    """``value`` as a whole number of 10**-digits units."""
    return F.round(value * F.lit(10**digits)).cast("bigint")


#: Digits kept before and after the point while adding up.
EXACT = "decimal(28,10)"


def exact(value: Column) -> Column:
    """``value`` with the digits of EXACT; NaN and infinity become NULL.

    A finite value beyond that range fails the query: a sum without it would be wrong.
    """
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    fits = value.try_cast(EXACT)
    error = F.raise_error(F.concat(F.lit("value out of range for an exact sum: "), number.cast("string"))).cast(EXACT)
    return F.when(finite & fits.isNull(), error).otherwise(fits)


def exact_sum(value: Column) -> Column:
    """Order-independent sum; NaN and infinite values count as missing, see ``exact``."""
    return F.sum(exact(value)).cast("double")


def exact_avg(value: Column) -> Column:
    """Order-independent mean; NaN and infinite values count as missing, see ``exact``."""
    number = exact(value)
    return F.try_divide(F.sum(number).cast("double"), F.count(number).cast("double"))


def weighted_sum(terms: list[tuple[float, Column]]) -> Column:
    """Sum of weight x term, left to right; NULL when any term is NULL."""
    return reduce(add, [F.lit(weight) * term for weight, term in terms])


def safe_percent_change(current: Column, previous: Column, digits: int = 2) -> Column:
    """Change from ``previous`` in percent; NULL when there is no non-zero base."""
    base = F.nullif(previous, F.lit(0.0))
    return F.round((current - base) / base * 100, digits)


def to_number(value: Column, source_type: str, target_type: str) -> Column:
    """Cast without raising: bad text becomes NULL.

    Text such as ``"3.7"`` is a valid count and truncates, so integer targets read
    text by way of double.
    """
    if source_type == "string" and target_type in ("int", "bigint", "smallint"):
        value = value.try_cast("double")
    return value.try_cast(target_type)
