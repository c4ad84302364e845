"""Small column formulas shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low, high) -> Column:
    """Value limited to [low, high]; null stays null."""
    inner = F.when(value > F.lit(high), F.lit(high)).when(value < F.lit(low), F.lit(low)).otherwise(value)
    return F.when(value.isNotNull(), inner)


def ratio(num: Column, den: Column, default=None) -> Column:
    """num / den, or ``default`` when the denominator is zero or null."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def rescale(value: Column, low, high, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Min-max map; a constant column (high == low) maps to ``to_low``."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    share = F.when(high > low, (value - low) / (high - low)).otherwise(value - low)
    return F.lit(to_low) + share * F.lit(to_high - to_low)


def band(value: Column, thresholds, words) -> Column:
    """Word of the first threshold above abs(value); the last word beyond all of them; 'undefined' for null."""
    size = F.abs(value)
    out = F.when(value.isNull(), F.lit("undefined"))
    for limit, word in zip(thresholds, words):
        out = out.when(size < F.lit(limit), F.lit(word))
    return out.otherwise(F.lit(words[len(thresholds)]))


def digamma(n: Column) -> Column:
    """psi of a whole number of 1 or more: six steps of the recurrence, then the asymptotic series (error below 1e-10)."""
    z = n.cast("double") + 6.0
    inv = F.lit(1.0) / (z * z)
    series = F.log(z) - 0.5 / z - inv * (F.lit(1 / 12) - inv * (F.lit(1 / 120) - inv * (F.lit(1 / 252) - inv / 240.0)))
    return reduce(lambda s, i: s - F.lit(1.0) / (n.cast("double") + float(i)), range(6), series)
