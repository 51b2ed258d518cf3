"""Band stacking and date pairing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions import spectral
from terradelta.functions.numbers import floor_div

# The 10 m bands blue, green, red and near infrared.
BANDS = ("B02", "B03", "B04", "B08")
ROW_BLOCK = 64
BAND_COLUMNS = tuple(b.lower() for b in BANDS)


def _pixel_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Pixel identity, with the word address when the rows were laid out by it."""
    address = [c for c in ("tile_row", "word", "block") if c in df.columns]
    return [*keys, *address, "row", "col"]


def stack_bands(px: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Long to wide: one row per pixel and date, one column per band (one aggregation)."""
    values = [
        F.max(F.when(F.col("band") == band, F.col("dn"))).alias(name)
        for band, name in zip(BANDS, BAND_COLUMNS)
    ]
    return px.groupBy("scene_date", *_pixel_keys(px, keys)).agg(*values)


def unstack_bands(px: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Wide to long, the inverse of :func:`stack_bands`."""
    return px.unpivot(
        [*keys, "scene_date", "row", "col"], list(BAND_COLUMNS), "band", "dn"
    ).withColumn("band", F.upper("band"))


def pair_columns(
    px: DataFrame, keys: Sequence[str], values: Sequence[str], partial: bool = False
) -> DataFrame:
    """Fold rows of ``date1`` and ``date2`` of each pixel into one row ``v_1 .. v_2``.

    One aggregation, no self join. Pixels seen on only one of the two dates are dropped, or with
    ``partial`` kept with nulls.
    """
    picked = [
        F.max(F.when(F.col("scene_date") == F.col(f"date{i}"), F.col(v))).alias(f"{v}_{i}")
        for i in (1, 2)
        for v in values
    ]
    seen = [
        F.max(F.col("scene_date") == F.col(f"date{i}")).alias(f"_seen_{i}") for i in (1, 2)
    ]
    grouped = px.groupBy(*_pixel_keys(px, keys), "date1", "date2").agg(*picked, *seen)
    return (grouped if partial else grouped.where("_seen_1 and _seen_2")).drop("_seen_1", "_seen_2")


def by_date(pairs: DataFrame) -> DataFrame:
    """``pairs`` once for each of its distinct dates, as ``scene_date``: a key to join pixels on."""
    return pairs.withColumn("scene_date", F.explode(F.array_distinct(F.array("date1", "date2"))))


def pair_dates(
    px: DataFrame,
    pairs: DataFrame,
    keys: Sequence[str] = ("aoi_id",),
    values: Sequence[str] = BAND_COLUMNS,
) -> DataFrame:
    """Align the two dates of each (keys, date1, date2) row of ``pairs`` pixel by pixel.

    Pixels meet only the pairs that ask for their date, and a large raster is split: its rows are dealt
    out by blocks, and the pairs to every block.
    """
    blocks = px.select(*keys, "scene_date", row_block("row").alias("block")).distinct()
    wanted = blocks.join(by_date(pairs), [*keys, "scene_date"]).repartition(*keys, "block")
    dealt = px.withColumn("block", row_block("row")).repartition(*keys, "block")
    met = dealt.join(wanted, [*keys, "scene_date", "block"])
    return pair_columns(met, keys, values).drop("block")


def row_block(row: str) -> Column:
    """A few raster rows, small enough for one task at any raster width."""
    return floor_div(F.col(row), ROW_BLOCK)


def by_block(rasters: DataFrame, keys: Sequence[str], height: str = "height") -> DataFrame:
    """A small table of rasters once for each ``block`` of raster rows, dealt out by raster and block.

    A join of pixels with it deals them out by block as well, so a raster that holds a large part of all
    pixels does not end up in one task; where the table is small enough Spark sends it to the pixels instead.
    """
    last = floor_div(F.col(height) - 1, ROW_BLOCK)
    return rasters.where(F.col(height) > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(*keys, "block")


def rgb_of(date: int) -> list[Column]:
    """Display colours of date 1 or 2 of a paired pixel, as unnamed expressions."""
    return [
        spectral.brightness(F.col(f"b04_{date}")),
        spectral.brightness(F.col(f"b03_{date}")),
        spectral.brightness(F.col(f"b02_{date}")),
    ]


def with_indices(df: DataFrame, suffixes: Sequence[str] = ("_1", "_2")) -> DataFrame:
    """Add ndvi and ndwi columns for each suffix."""
    out = {}
    for s in suffixes:
        out[f"ndvi{s}"] = spectral.ndvi(F.col(f"b08{s}"), F.col(f"b04{s}"))
        out[f"ndwi{s}"] = spectral.ndwi(F.col(f"b03{s}"), F.col(f"b08{s}"))
    return df.withColumns(out)


def change_flags() -> dict[str, Column]:
    """Raw change, vegetation and water flags of a paired pixel, before mask cleaning."""
    drop, rise = spectral.index_deltas(
        spectral.ndvi(F.col("b08_1"), F.col("b04_1")),
        spectral.ndvi(F.col("b08_2"), F.col("b04_2")),
        spectral.ndwi(F.col("b03_1"), F.col("b08_1")),
        spectral.ndwi(F.col("b03_2"), F.col("b08_2")),
    )
    values = [F.col(f"{b}_{i}").isNotNull() for i in (1, 2) for b in BAND_COLUMNS]
    return {
        "complete": reduce(and_, values),
        "mask": spectral.rgb_changed(rgb_of(1), rgb_of(2)),
        "vegetation": spectral.lost_vegetation(drop),
        "water": spectral.moved_water(rise),
    }
