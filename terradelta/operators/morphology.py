"""Erosion, dilation, opening and closing of masks with square n x n neighbourhoods (n odd).

Pixels beyond the raster's edge take no part. Rasters are dense rectangles per key.
A chain of steps costs one exchange of packed words (see ``bitrows``), not one per step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta.operators import bitrows
from terradelta.operators.bitrows import MAX_HALO, shift_left, shift_right

Step = tuple[str, int]  # ("erode" | "dilate", radius)


def radius_of(n: int) -> int:
    if n < 1 or n % 2 == 0:
        raise ValueError("neighbourhood size must be odd")
    return n // 2


def erosion(n: int) -> list[Step]:
    return [("erode", radius_of(n))]


def dilation(n: int) -> list[Step]:
    return [("dilate", radius_of(n))]


def opening(n: int) -> list[Step]:
    return [("erode", radius_of(n)), ("dilate", radius_of(n))]


def closing(n: int) -> list[Step]:
    return [("dilate", radius_of(n)), ("erode", radius_of(n))]


def cleaning(n: int) -> list[Step]:
    """Opening then closing; its two middle dilations are one of twice the radius."""
    return [("erode", radius_of(n)), ("dilate", 2 * radius_of(n)), ("erode", radius_of(n))]


def halo_of(steps: Sequence[Step]) -> int:
    """Halo that makes a chain of steps local to a word group."""
    return max(1, min(MAX_HALO, sum(r for _, r in steps)))


def _fold(value: Column, radius: int, join: Callable[[Column, Column], Column]) -> Column:
    """Combine a word with its copies shifted by 1..radius pixels to both sides."""
    out = value
    for s in range(1, radius + 1):
        out = join(join(out, shift_left(value, s)), shift_right(value, s))
    return out


def apply_step(words: DataFrame, keys: Sequence[str], names: Sequence[str], step: Step) -> DataFrame:
    """One erosion or dilation of several flags of spread words at once."""
    kind, radius = step
    if radius == 0:
        return words
    around = (
        Window.partitionBy(*keys, "tile_row", "word").orderBy("row").rangeBetween(-radius, radius)
    )
    present = F.col("present")
    result = {}
    for name in names:
        if kind == "erode":
            # missing pixels must not erode their neighbours: count them as set
            wide = _fold(
                F.col(name).bitwiseOR(F.bitwise_not(present)), radius, lambda a, b: a.bitwiseAND(b)
            )
            folded = F.bit_and(wide).over(around)
        else:
            wide = _fold(F.col(name), radius, lambda a, b: a.bitwiseOR(b))
            folded = F.bit_or(wide).over(around)
        result[name] = folded.bitwiseAND(present)
    return words.withColumns(result)


def _rounds(steps: Sequence[Step]) -> list[list[Step]]:
    """Group steps so that each group's total radius fits the halo."""
    rounds: list[list[Step]] = [[]]
    left = MAX_HALO
    for kind, radius in steps:
        while radius > 0:
            if left == 0:
                rounds.append([])
                left = MAX_HALO
            part = min(radius, left)
            rounds[-1].append((kind, part))
            radius, left = radius - part, left - part
    return rounds


def transform_words(
    words: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    steps: Sequence[Step],
    carry: Sequence[str] = (),
    halo: int | None = None,
) -> DataFrame:
    """Run ``steps`` on packed words; ``carry`` columns travel along unchanged.

    ``halo`` is what the words were packed with, by default the smallest that fits the steps.
    """
    halo = halo or halo_of(steps)
    if halo < halo_of(steps):
        raise ValueError("the words were packed with too small a halo for these steps")
    for part in _rounds(steps):
        words = bitrows.spread(words, keys, [*names, *carry], halo)
        for step in part:
            words = apply_step(words, keys, names, step)
        words = bitrows.owned(words, [*names, *carry], halo)
    return words


def transform_mask(df: DataFrame, mask: str, steps: Sequence[Step], keys: Sequence[str]) -> DataFrame:
    """Run ``steps`` on a 0/1 pixel column; returns keys, row, col and the new mask."""
    halo = halo_of(steps)
    words = bitrows.pack(df, keys, {mask: F.col(mask) != 0}, halo)
    words = transform_words(words, keys, [mask], steps)
    return bitrows.unpack(words, keys, [mask], halo)


def erode(df: DataFrame, mask: str, n: int = 3, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return transform_mask(df, mask, erosion(n), keys)


def dilate(df: DataFrame, mask: str, n: int = 3, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return transform_mask(df, mask, dilation(n), keys)


def morph_open(df: DataFrame, mask: str, n: int = 3, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return transform_mask(df, mask, opening(n), keys)


def morph_close(df: DataFrame, mask: str, n: int = 3, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return transform_mask(df, mask, closing(n), keys)


def morph_clean(df: DataFrame, mask: str, n: int = 3, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return transform_mask(df, mask, cleaning(n), keys)
