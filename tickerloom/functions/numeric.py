"""Column helpers for clipping, rounding and the normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: 95 % point of the standard normal distribution
Z95 = 1.6448536269514722

# fixed values: coefficients of the rational approximation of erf
# (Abramowitz & Stegun 7.1.26, absolute error below 1.5e-7)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """x inside [lo, hi]; NULL stays NULL (least and greatest alone skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def rnd(x: Column, digits: int) -> Column:
    """Round half to even on the scaled double, as `rint` does."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def rnd_stable(x: Column, digits: int) -> Column:
    """Round twice, so that a tie does not depend on the order of a sum."""
    return rnd(rnd(x, 9), digits)


def pct_change(a: Column, b: Column) -> Column:
    """(a / b - 1) * 100, NULL when b is zero or missing."""
    return (F.try_divide(a, b) - 1) * 100


def points(condition: Column, yes: float, no: float = 0.0) -> Column:
    """Score contribution; an unknown condition adds nothing at all."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no)).otherwise(F.lit(0.0))


def norm_pdf(x: Column) -> Column:
    return F.exp(-(x * x) / 2) / F.lit(math.sqrt(2 * math.pi))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function in pure column arithmetic."""
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = 1 / (1 + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    tail = poly * F.exp(-(z * z)) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def lines(*parts: Column) -> Column:
    """Array of the non-null text parts, in order."""
    return F.array_compact(F.array(*parts))


def bullish(direction: Column) -> Column:
    return direction.isin("bullish", "neutral_to_bullish")


def bearish(direction: Column) -> Column:
    return direction.isin("bearish", "neutral_to_bearish")
