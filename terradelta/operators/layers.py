"""Display rasters and map feature layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions import spectral
from terradelta.functions.projection import from_crs
from terradelta.operators import bitrows, morphology
from terradelta.operators.bands import by_block, change_flags, rgb_of, row_block
from terradelta.operators.metrics import class_words
from terradelta.operators.regions import pixel_xy

# Layer names, labels and styles of the map features.
BORDER_LAYER = "Yellow AOI Border"
BORDER_TOOLTIP = "AOI Boundary"
POINT_LAYERS = {
    "new_construction": ("Red Dots (New Construction)", "New Construction", "red"),
    "surface_water": ("Blue Dots (Surface Water)", "Surface Water Change", "blue"),
}
BORDER_STYLE = {"color": "yellow", "weight": 3, "fill": True, "fill_color": "yellow", "fill_opacity": 0.15}
POINT_STYLE = {"radius": 5, "fill": True, "fill_opacity": 0.85}


OVERLAY_STEPS = [*morphology.cleaning(3), *morphology.dilation(3)]


def change_overlay(
    pairs: DataFrame, keys: Sequence[str], addressed_halo: int | None = None
) -> DataFrame:
    """Date-2 colours with the dilated construction and water masks painted on them.

    Cleaning and display dilation run on one spread of packed words; the paint bits then meet the
    pixels in an equi join on (keys, tile_row, word, row). ``addressed_halo`` says for which halo the
    pairs carry word addresses, if they do.
    """
    steps = morphology.cleaning(3)
    halo = morphology.halo_of(OVERLAY_STEPS)
    addressed = pairs if addressed_halo == halo else bitrows.with_address(pairs, halo)
    words = bitrows.pack(addressed, keys, change_flags(), halo)
    words = bitrows.spread(words, keys, ["mask", "vegetation", "water"], halo)
    for step in steps:
        words = morphology.apply_step(words, keys, ["mask"], step)
    classes = class_words()
    paint = {"construction": classes["new_construction"], "open_water": classes["surface_water"]}
    words = words.withColumns(paint)
    words = morphology.apply_step(words, keys, list(paint), ("dilate", 1))
    words = bitrows.owned(words, list(paint), halo)
    return _painted(addressed, words, keys, halo)


def overlay_of_words(pairs: DataFrame, words: DataFrame, keys: Sequence[str], halo: int) -> DataFrame:
    """As ``change_overlay``, from addressed pairs and the cleaned words that are there already.

    Only words move for the display dilation; nothing is packed or cleaned again.
    """
    classes = class_words()
    paint = {"construction": classes["new_construction"], "open_water": classes["surface_water"]}
    shown = words.select(*keys, *bitrows.ADDRESS, "present", *[c.alias(n) for n, c in paint.items()])
    wide = morphology.transform_words(shown, keys, list(paint), morphology.dilation(3), [], halo)
    return _painted(pairs, wide, keys, halo)


def _painted(addressed: DataFrame, words: DataFrame, keys: Sequence[str], halo: int) -> DataFrame:
    """Date-2 colours of addressed pairs with the flags construction and open_water of their words painted on."""
    paint = ("construction", "open_water")
    base = addressed.select(
        *keys,
        *bitrows.ADDRESS,
        "col",
        *[c.alias(f"base_{i}") for i, c in enumerate(rgb_of(2))],
    )
    joined = bitrows.attach(base, words, keys, list(paint), halo)
    painted = spectral.painted(
        [F.col(f"base_{i}") for i in range(3)],
        F.col("construction") == 1,
        F.col("open_water") == 1,
    )
    return joined.select(*keys, "row", "col", *painted)


def side_by_side(panels: Sequence[DataFrame], widths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rasters (row, col, red, green, blue) next to each other; ``widths`` has keys, width and height."""
    columns = ["row", "col", "red", "green", "blue"]
    frames = by_block(widths.select(*keys, "width", "height"), keys).drop("height")
    shifted = [
        panel.select(*keys, *columns)
        .withColumn("block", row_block("row"))
        .join(frames, [*keys, "block"])
        .withColumn("col", F.col("col") + F.col("width") * i)
        .drop("width", "block")
        for i, panel in enumerate(panels)
    ]
    return reduce(DataFrame.unionByName, shifted)


def lonlat_points(points: DataFrame, meta: DataFrame, on: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Add the lat and lon of pixel centres."""
    placed = pixel_xy(points, meta, on, ["epsg"])
    lon, lat = from_crs(F.col("x"), F.col("y"), F.col("epsg"))
    return placed.withColumns({"lat": lat, "lon": lon}).drop("x", "y", "epsg")


def _style(values: dict[str, object]) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def _whose(keys: Sequence[str]) -> list[Column]:
    """The keys as properties, so that a feature read alone still names its request."""
    return [F.col(k).cast("string").alias(k) for k in keys]


def border_features(aois: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One styled polygon feature per ring, as GeoJSON text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Polygon").alias("type"), F.array(F.col("coords")).alias("coordinates")
        ).alias("geometry"),
        F.struct(*_whose(keys), F.lit(BORDER_TOOLTIP).alias("tooltip"), *_style(BORDER_STYLE)).alias("properties"),
    )
    return aois.select(*keys, F.lit(BORDER_LAYER).alias("layer"), F.to_json(feature).alias("feature"))


def point_features(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One styled point feature per sampled pixel (class, lat, lon), as GeoJSON text."""

    def of_class(pick: int) -> Column:
        first, *rest = POINT_LAYERS.items()
        chain = F.when(F.col("class") == first[0], F.lit(first[1][pick]))
        for name, values in rest:
            chain = chain.when(F.col("class") == name, F.lit(values[pick]))
        return chain

    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
        ).alias("geometry"),
        F.struct(
            *_whose(keys), of_class(1).alias("popup"), of_class(2).alias("color"), of_class(2).alias("fill_color"), *_style(POINT_STYLE)
        ).alias("properties"),
    )
    return points.select(*keys, of_class(0).alias("layer"), F.to_json(feature).alias("feature"))


def feature_layers(aois: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Border and point features in one table (keys, layer, feature)."""
    return border_features(aois, keys).unionByName(point_features(points, keys))
