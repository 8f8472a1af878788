"""Rounding of the exact binary value, ties to even.

Spark rounds the shortest decimal text of a double, half up: 0.15 becomes 0.2, though the number is a little below
0.15. Printed messages and scores here follow the value itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_half_even(x: Column, digits: int) -> Column:
    """``x * 10^digits`` as the nearest whole number, decided exactly.

    The distance to the midpoint between two candidates is computed from the upper and lower half of the mantissa, so
    no product is rounded.
    """
    scale = 10**digits
    low = F.floor(x * scale)
    upper = x.cast("float").cast("double")
    lower = x - upper
    distance = (upper * (2 * scale) - (low * 2 + 1)) + lower * (2 * scale)
    return low + F.when(distance > 0, 1).when(distance < 0, 0).otherwise(F.pmod(low, F.lit(2)))


def round_half_even(x: Column, digits: int) -> Column:
    """The rounded double."""
    return scaled_half_even(x, digits) / F.lit(10.0**digits)


def fixed_text(x: Column, digits: int) -> Column:
    """The number with exactly ``digits`` decimals."""
    whole = scaled_half_even(x, digits)
    size = F.abs(whole)
    scale = F.lit(10**digits).cast("long")
    sign = F.when((whole < 0) | ((whole == 0) & (x < 0)), "-").otherwise("")
    fraction = F.lpad((size % scale).cast("string"), digits, "0")
    return F.concat(sign, F.floor(size / scale).cast("string"), F.lit("."), fraction)
