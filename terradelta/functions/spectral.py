"""Per-pixel colour, index and difference expressions.

All of them are built-in column expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta.functions.numbers import int_div

# Reflectance that maps to full brightness, change thresholds on the 0..255 scale,
# index change thresholds, and the colours painted on the overlay.
MAX_DN = 2500
RGB_THRESHOLD = 25
GRAY_THRESHOLD = 30
VEGETATION_THRESHOLD = 0.15
WATER_THRESHOLD = 0.15
CONSTRUCTION_RGB = (255, 0, 0)
WATER_RGB = (0, 100, 255)


def brightness(dn: Column, max_dn: int = MAX_DN) -> Column:
    """Digital number to 0..255, clipped at ``max_dn`` and truncated; null stays null."""
    clipped = F.least(F.greatest(dn.cast("long"), F.lit(0).cast("long")), F.lit(max_dn).cast("long"))
    return F.when(dn.isNotNull(), int_div(clipped * 255, max_dn).cast("int"))


def natural_rgb(red: Column, green: Column, blue: Column, max_dn: int = MAX_DN) -> list[Column]:
    """Red, green and blue display values of the three visible bands."""
    return [
        brightness(red, max_dn).alias("red"),
        brightness(green, max_dn).alias("green"),
        brightness(blue, max_dn).alias("blue"),
    ]


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) in single precision, 0 where the sum is 0 and null where a value is missing."""
    fa, fb = a.cast("float"), b.cast("float")
    total = fa + fb
    return F.when(total == 0, F.lit(0.0).cast("float")).otherwise(((fa - fb) / total).cast("float"))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def summed_rgb_difference(first: list[Column], second: list[Column]) -> Column:
    """Sum of the absolute channel differences (an integer)."""
    return reduce(add, [absolute_difference(b, a) for a, b in zip(first, second)])


def rgb_difference(first: list[Column], second: list[Column]) -> Column:
    """Mean absolute channel difference."""
    return summed_rgb_difference(first, second) / F.lit(float(len(first)))


def threshold(value: Column, limit: float) -> Column:
    """1 where ``value`` is strictly above ``limit``, else 0."""
    return F.when(value > limit, F.lit(1)).otherwise(F.lit(0))


def rgb_changed(first: list[Column], second: list[Column], limit: int = RGB_THRESHOLD) -> Column:
    """Mean difference above ``limit``, decided on the integer sum to avoid a division."""
    return summed_rgb_difference(first, second) > limit * len(first)


def grayscale(red: Column, green: Column, blue: Column) -> Column:
    """Luma of an RGB triple, in 15-bit fixed point."""
    weighted = red * 9798 + green * 19235 + blue * 3735 + 16384
    return F.shiftright(weighted, 15).cast("int")


def mask_to_rgb(mask: Column) -> list[Column]:
    """A 0/1 mask as three equal display channels."""
    value = (mask * 255).cast("int")
    return [value.alias("red"), value.alias("green"), value.alias("blue")]


def index_deltas(ndvi1: Column, ndvi2: Column, ndwi1: Column, ndwi2: Column) -> list[Column]:
    return [(ndvi1 - ndvi2).alias("ndvi_drop"), (ndwi2 - ndwi1).alias("ndwi_rise")]


def lost_vegetation(ndvi_drop: Column, limit: float = VEGETATION_THRESHOLD) -> Column:
    return ndvi_drop > F.lit(limit).cast("float")


def moved_water(ndwi_rise: Column, limit: float = WATER_THRESHOLD) -> Column:
    """True for a gain as well as for a loss of surface water."""
    return F.abs(ndwi_rise) > F.lit(limit).cast("float")


def class_flags(changed: Column, vegetation: Column, water: Column) -> list[Column]:
    """Three boolean classes; vegetation loss and surface water may overlap."""
    return [
        (changed & vegetation).alias("vegetation_loss"),
        (changed & water).alias("surface_water"),
        (changed & ~vegetation & ~water).alias("new_construction"),
    ]


def painted(base: list[Column], construction: Column, water: Column) -> list[Column]:
    """Base colours with construction painted on them and water painted on top."""
    names = ("red", "green", "blue")
    return [
        F.when(water, F.lit(w)).when(construction, F.lit(c)).otherwise(b).cast("int").alias(name)
        for name, b, c, w in zip(names, base, CONSTRUCTION_RGB, WATER_RGB)
    ]
