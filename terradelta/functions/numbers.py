"""Exact integer arithmetic helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient, truncated towards zero; the result is a bigint."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def floor_div(a: Column, b: int) -> Column:
    """Integer quotient rounded down, for a positive divisor and any sign of ``a``."""
    return int_div(a - F.pmod(a, F.lit(b)), b).cast("long")


def percent(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent with two digits, half up; NULL when ``total`` is 0."""
    return F.when(total != 0, int_div(part * 20000 + total, total * 2) / F.lit(100.0))


def area_km2(pixels: Column, digits: int = 2) -> Column:
    """Area of 10 m x 10 m pixels in square kilometres, rounded half up to 2 or 4 digits."""
    if digits == 4:
        return pixels / F.lit(10000.0)
    if digits == 2:
        return int_div(pixels + 50, 100) / F.lit(100.0)
    raise ValueError("digits must be 2 or 4")
