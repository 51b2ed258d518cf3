"""Polygons on rasters: crop windows, burned-in masks and clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions import rings
from terradelta.functions.numbers import floor_div
from terradelta.functions.once import with_once
from terradelta.functions.projection import from_crs
from terradelta.operators.bitrows import TILE_ROWS, bit_at, core_bits, core_width, position_of, shift_left
from terradelta.session import fan_out

# Fixed value: points added between the corners of each edge when bounds are projected.
DENSIFY_POINTS = 21


def pixel_xy(
    df: DataFrame, meta: DataFrame, on: Sequence[str] = ("aoi_id",), carry: Sequence[str] = ()
) -> DataFrame:
    """Map coordinates of pixel centres; ``carry`` names further meta columns to keep."""
    frame = meta.select(*on, "x0", "y0", "px", "py", *carry)
    return (
        df.join(frame, list(on))
        .withColumn("x", F.col("x0") + (F.col("col") + 0.5) * F.col("px"))
        .withColumn("y", F.col("y0") - (F.col("row") + 0.5) * F.col("py"))
        .drop("x0", "y0", "px", "py")
    )


def place_rings(regions: DataFrame, meta: DataFrame, on: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Add ``ring``: the lon/lat ``coords`` in fractional (col, row) coordinates of the raster."""
    projected = rings.ring_to_crs(F.col("coords"), F.col("epsg"))
    met = with_once(regions.join(meta, list(on)), {"planar_ring": projected})
    return place_planar_rings(met).drop("planar_ring")


def place_planar_rings(regions: DataFrame) -> DataFrame:
    """Add ``ring`` from a ``planar_ring`` in raster CRS metres; needs the raster_meta columns."""
    ring = rings.ring_to_pixels(
        F.col("planar_ring"), F.col("x0"), F.col("y0"), F.col("px"), F.col("py")
    )
    return with_once(regions, {"ring": ring})


def crop_window(placed: DataFrame) -> DataFrame:
    """Ring bounds snapped outward to whole pixels, inside the raster, and the cropped frame.

    A region that does not touch its raster gets an empty window (see :func:`touching`); one without a ring, as
    where the raster's CRS is not supported, is left out.
    """
    x_min, y_min, x_max, y_max = rings.bounds(F.col("ring"))
    zero = F.lit(0).cast("long")
    return (
        with_once(
            placed.where(F.col("ring").isNotNull()),
            {
                "col_min": F.greatest(F.floor(x_min), zero),
                "col_max": F.least(F.ceil(x_max), F.col("width")) - 1,
                "row_min": F.greatest(F.floor(y_min), zero),
                "row_max": F.least(F.ceil(y_max), F.col("height")) - 1,
            },
        )
        .withColumns(
            {
                "crop_x0": F.col("x0") + F.col("col_min") * F.col("px"),
                "crop_y0": F.col("y0") - F.col("row_min") * F.col("py"),
                "crop_width": F.col("col_max") - F.col("col_min") + 1,
                "crop_height": F.col("row_max") - F.col("row_min") + 1,
            }
        )
    )


def touching(windows: DataFrame) -> DataFrame:
    """Windows that hold at least one pixel of their raster."""
    return windows.where("crop_width > 0 and crop_height > 0")


def burn(windows: DataFrame, keys: Sequence[str], halo: int, carry: Sequence[str] = ()) -> DataFrame:
    """Polygons as packed masks: one row per raster row and word of each crop window.

    ``inside`` has a bit set where a pixel centre lies in the ring (even-odd rule). Every edge is swept on its
    own: it becomes one row for each raster row that it crosses, which flips all pixels to its right. A word's
    own crossings are united by a grouped exclusive or, those to its left by their parity, so a border of many
    edges costs its crossings and not edges times rows. Output: keys, carry, tile_row, word, row, inside,
    col_min, col_max.
    """
    core = core_width(halo)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    limits = [*keys, *carry, "row_min", "row_max", "col_min", "col_max"]
    first_tile, last_tile = (floor_div(F.col(c), TILE_ROWS) for c in ("row_min", "row_max"))
    tiles = windows.select(*limits, F.explode(F.sequence(first_tile, last_tile)).alias("tile_row"))
    nothing = {"at_row": F.lit(None).cast("long"), "at_word": F.lit(None).cast("long"), "flipped": zero, "crossings": zero}
    dealt = (
        tiles.withColumns(nothing)
        .unionByName(_crossings(windows.select(*limits, "ring"), core, halo))
        # a few windows can unfold to many rows: deal out their tiles before that
        .repartition(fan_out(windows.sparkSession), *keys, "tile_row")
    )
    top = F.greatest(F.col("row_min"), F.col("tile_row") * TILE_ROWS)
    bottom = F.least(F.col("row_max"), F.col("tile_row") * TILE_ROWS + (TILE_ROWS - 1))
    words = F.sequence(floor_div(F.col("col_min"), core), floor_div(F.col("col_max"), core))
    crossed = F.col("at_row").isNotNull()
    rows = dealt.withColumn("row", F.explode(F.when(crossed, F.array("at_row")).otherwise(F.sequence(top, bottom))))
    cells = rows.withColumn("word", F.explode(F.when(crossed, F.array("at_word")).otherwise(words)))
    united = cells.groupBy(*limits, "tile_row", "row", "word").agg(
        F.bit_xor("flipped").alias("flipped"), F.sum("crossings").alias("crossings")
    )
    before = Window.partitionBy(*keys, "tile_row", "row").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("crossings").over(before), zero).bitwiseAND(one) == 1
    whole = F.when(odd, shift_left(F.lit(-1).cast("long"), halo)).otherwise(zero)
    return united.select(
        *keys,
        *carry,
        "tile_row",
        "word",
        "row",
        F.col("flipped").bitwiseXOR(whole).bitwiseAND(core_bits(halo)).alias("inside"),
        "col_min",
        "col_max",
    )


def _crossings(windows: DataFrame, core: int, halo: int) -> DataFrame:
    """One row per ring edge and raster row that it crosses, with the word where it does.

    An edge crosses the rows whose centre lies at or below its upper end and above its lower one, so that no
    vertex counts twice. Crossings right of the window flip nothing and are left out.
    """
    edges = windows.select("*", F.explode(rings.edges(F.col("ring"))).alias("e")).drop("ring").select("*", "e.*").drop("e")
    upper, lower = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.ceil(upper - 0.5), F.col("row_min"))
    last = F.least(F.ceil(lower - 0.5) - 1, F.col("row_max"))
    swept = edges.where(first <= last).withColumn("at_row", F.explode(F.sequence(first, last)))
    y = F.col("at_row") + 0.5
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    met = swept.where((F.col("y1") > y) != (F.col("y2") > y)).withColumn("at_col", F.greatest(F.ceil(at - 0.5), F.col("col_min")))
    placed = met.where("at_col <= col_max").withColumn("at_word", floor_div(F.col("at_col"), core))
    skipped = (F.col("at_col") - F.col("at_word") * core + halo).cast("int")
    return placed.withColumns(
        {
            "tile_row": floor_div(F.col("at_row"), TILE_ROWS),
            "flipped": shift_left(F.lit(-1).cast("long"), skipped),
            "crossings": F.lit(1).cast("long"),
        }
    ).drop("x1", "y1", "x2", "y2", "at_col")


def clip(px: DataFrame, masks: DataFrame, on: Sequence[str], halo: int, values: Sequence[str]) -> DataFrame:
    """Keep the crop rectangles of addressed pixels; zero ``values`` outside the polygon.

    Pixels join the burned masks on (raster, tile_row, word, row): an equi join on a fine key, so a
    raster that holds a large part of all pixels does not end up in one task.
    """
    inside = bit_at(F.col("inside"), position_of(F.col("col"), halo)) == 1
    return (
        px.join(masks, [*on, "tile_row", "word", "row"])
        .where(F.col("col").between(F.col("col_min"), F.col("col_max")))
        # a missing value stays missing, inside and outside
        .withColumns({v: F.when(inside | F.col(v).isNull(), F.col(v)).otherwise(F.lit(0)) for v in values})
        .withColumn("inside", inside.cast("int"))
        .drop("col_min", "col_max")
    )


def bounds_center(meta: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Lon/lat bounds of each raster, from densified edges, and their centre."""
    steps = DENSIFY_POINTS + 1
    part = F.col("i") / F.lit(float(steps))
    left, top = F.col("x0"), F.col("y0")
    right = F.col("x0") + F.col("width") * F.col("px")
    bottom = F.col("y0") - F.col("height") * F.col("py")
    along_x = left + (right - left) * part
    along_y = bottom + (top - bottom) * part
    frame = meta.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    points = frame.select(
        *keys,
        "epsg",
        F.inline(
            F.array(
                F.struct(along_x.alias("x"), top.alias("y")),
                F.struct(along_x.alias("x"), bottom.alias("y")),
                F.struct(left.alias("x"), along_y.alias("y")),
                F.struct(right.alias("x"), along_y.alias("y")),
            )
        ),
    )
    lon, lat = from_crs(F.col("x"), F.col("y"), F.col("epsg"))
    return (
        points.select(*keys, lon.alias("lon"), lat.alias("lat"))
        .groupBy(*keys)
        .agg(
            F.min("lon").alias("lon_min"),
            F.min("lat").alias("lat_min"),
            F.max("lon").alias("lon_max"),
            F.max("lat").alias("lat_max"),
        )
        .withColumn("center_lat", (F.col("lat_min") + F.col("lat_max")) / 2.0)
        .withColumn("center_lon", (F.col("lon_min") + F.col("lon_max")) / 2.0)
    )


def raster_extent(px: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Row and column range, size and pixel count of each raster."""
    return (
        px.groupBy(*keys)
        .agg(
            F.min("row").alias("row_min"),
            F.max("row").alias("row_max"),
            F.min("col").alias("col_min"),
            F.max("col").alias("col_max"),
            F.count(F.lit(1)).alias("pixels"),
        )
        .withColumn("width", F.col("col_max") - F.col("col_min") + 1)
        .withColumn("height", F.col("row_max") - F.col("row_min") + 1)
    )
