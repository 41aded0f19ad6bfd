"""Exact half-up ratios.

Percentages and averages are worked out on integers and only the rounded result
becomes a double, so a result depends neither on the order in which partitions
are summed nor on how an engine rounds binary fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

_SUM = "decimal(34,2)"
_INT = "decimal(38,0)"


def ratio(num: Column, den: Column, mult: int = 1, dp: int = 2) -> Column:
    """``round(num / den * mult, dp)`` half-up as a double; NULL where ``den`` is 0.

    ``num`` may be negative, ``den`` must not be. Both may be counts or sums of
    amounts with two decimals.
    """
    hundredths = lambda c: (c.cast(_SUM) * F.lit(100)).cast(_INT)
    n, d = hundredths(F.abs(num)), hundredths(den)
    units = F.call_function("div", n * F.lit(2 * mult * 10**dp) + d, d * F.lit(2))
    signed = F.when(num < 0, -units).otherwise(units)
    return F.when(den != 0, signed.cast("double") / F.lit(float(10**dp)))


def pct(num: Column, den: Column, dp: int = 2) -> Column:
    return ratio(num, den, mult=100, dp=dp)


def mean(total: Column, n: Column, dp: int = 2) -> Column:
    return ratio(total, n, mult=1, dp=dp)


def safe_divide(num: Column, den: Column, alternate: float = 0.0) -> Column:
    """Plain division on doubles with ``alternate`` for a zero or missing divisor."""
    return F.coalesce(
        F.try_divide(num.cast("double"), den.cast("double")), F.lit(alternate)
    )


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Amounts leave the library as doubles, as the report tables declare them."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
