"""Rounding of a double by its exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(c: Column, digits: int) -> Column:
    """Round to a few digits: nearest by the exact binary value, an exact tie to the even digit.

    ``round`` works on the printed decimal, so 2.0005 (whose binary value is below the tie) would go
    up.  Here the distance to the tie is computed without rounding error: the value is cut into two
    halves whose products with the power of ten are exact.
    """
    scale = float(10**digits)
    shifted = c * F.lit(134217729.0)  # 2**27 + 1 splits a double into two 26-bit halves
    high = shifted - (shifted - c)
    low = c - high
    below = F.floor(c * F.lit(scale)).cast("double")
    distance = (high * F.lit(scale) - (below + F.lit(0.5))) + low * F.lit(scale)
    odd = F.pmod(below, F.lit(2.0)) == 1.0
    up = F.when((distance > 0) | ((distance == 0) & odd), F.lit(1.0)).otherwise(F.lit(0.0))
    return (below + up) / F.lit(scale)


def round3(c: Column) -> Column:
    return round_exact(c, 3)


def unit_interval(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
