"""Where stored pixels lie: square blocks of a raster dealt out to a fixed number of zones, a space-filling curve inside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.numbers import floor_div

ZONES = 1024  # folders of a store, however many rasters it holds
BLOCK = 2048  # rows and columns of a block, a multiple of bitrows.TILE_ROWS
_LAST = (1 << 31) - 1
# Halves of a word to move apart when the bits of a number make room for those of another.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def zone_name(ids: Sequence[str]) -> str:
    """Name of the zone column of a store whose rasters are named by ``ids``; it tells a reader how to find the zone."""
    return "_".join(["curve_zone_by", *sorted(ids)])


def zone_of(ids: Mapping[str, Column], block_row: Column, block_col: Column) -> Column:
    """The zone of a block of the raster that ``ids`` name: its blocks lie in zones of their own, so a large raster is in all of them."""
    named = [ids[name].cast("string") for name in sorted(ids)]
    return F.pmod(F.xxhash64(*named, block_row.cast("long"), block_col.cast("long")), F.lit(ZONES)).cast("int")


def zones_of_window(ids: Sequence[str], tile_row: Column, rows_per_tile: int, first_col: Column, last_col: Column) -> Column:
    """The zones that hold columns ``first_col`` to ``last_col`` of a tile (of ``rows_per_tile`` rows, which divide BLOCK), as an array."""
    block_row = floor_div(tile_row, BLOCK // rows_per_tile)
    named = {name: F.col(name) for name in ids}
    blocks = F.sequence(floor_div(first_col, BLOCK), floor_div(last_col, BLOCK))
    return F.array_distinct(F.transform(blocks, lambda block: zone_of(named, block_row, block)))


def along_curve(df: DataFrame, side: int, first: Sequence[str]) -> DataFrame:
    """Sort each partition by ``first``, then tiles of ``side`` rows and columns along the Z curve, then row and column.

    Neighbours in a file are neighbours on the raster, in both directions, so the least and largest row and
    column of a group of rows, which Parquet keeps, tell most groups outside a window.
    """
    parts = {f"_tile_{axis}": floor_div(F.greatest(F.col(axis), F.lit(0)), side) for axis in ("row", "col")}
    spread = df.withColumns({name: F.least(tile, F.lit(_LAST)) for name, tile in parts.items()})
    for by, mask in _SPREAD:
        wider = {n: (F.col(n).bitwiseOR(F.shiftleft(n, by))).bitwiseAND(F.lit(mask)) for n in parts}
        spread = spread.withColumns(wider)  # step by step: one expression would repeat each step twice
    curve = F.shiftleft("_tile_row", 1).bitwiseOR(F.col("_tile_col"))
    return spread.withColumn("_curve", curve).drop(*parts).sortWithinPartitions(*first, "_curve", "row", "col").drop("_curve")
