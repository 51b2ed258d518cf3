"""Polygons over several rasters: frames are found by shape, pixels meet on a common grid, the first raster wins.

Rasters of one CRS whose pixels have the same size and fall into line lie on one lattice. Rows and columns are
counted from a corner of the CRS there, so neighbouring and overlapping rasters share their addresses, and
everything that works on one raster works on a lattice.

A frame is a row of raster_meta keyed by ``raster_id``: epsg, x0, y0, px, py, width, height.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions import rings
from terradelta.functions.numbers import floor_div
from terradelta.functions.once import with_once
from terradelta.functions.projection import corner_of, is_supported
from terradelta.operators import bitrows
from terradelta.operators.regions import bounds_center, burn, clip
from terradelta.operators.scenes import CELL_DEGREES, to_cells
from terradelta.sources.curve import zone_name, zones_of_window

PHASES = 1000  # parts of a pixel in which rasters must fall into line to share a lattice
LATTICE = ("lattice", "lattice_x0", "lattice_y0", "epsg", "px", "py")

_VALUE_BITS = 33  # room for an int and for "missing" below a rank
_ZERO = (1 << 31) + 1


def on_lattice(frames: DataFrame) -> DataFrame:
    """Frames of supported CRS with their lattice, its origin, and ``row0``, ``col0``: where the raster begins on it."""
    left, top = corner_of(F.col("epsg"))
    known = with_once(frames.where(is_supported(F.col("epsg"))), {"_left": left, "_top": top})
    counted = with_once(
        known,
        {
            "_x": F.round((F.col("x0") - F.col("_left")) / F.col("px") * PHASES).cast("long"),
            "_y": F.round((F.col("_top") - F.col("y0")) / F.col("py") * PHASES).cast("long"),
        },
    )
    phase = {n: F.pmod(F.col(n), F.lit(PHASES)) for n in ("_x", "_y")}
    placed = with_once(
        counted,
        {
            "lattice": F.concat_ws(":", "epsg", "px", "py", phase["_x"], phase["_y"]),
            "lattice_x0": F.col("_left") + phase["_x"] / PHASES * F.col("px"),
            "lattice_y0": F.col("_top") - phase["_y"] / PHASES * F.col("py"),
            "col0": floor_div(F.col("_x"), PHASES),
            "row0": floor_div(F.col("_y"), PHASES),
        },
    )
    return placed.drop("_x", "_y", "_left", "_top")


def rasters_in_reach(regions: DataFrame, frames: DataFrame, keys: Sequence[str], cell: float = CELL_DEGREES) -> DataFrame:
    """``(keys, raster_id)`` of the rasters whose bounds meet a region's (column ``coords``, a lon/lat ring).

    A grid index: both sides are dealt out to the cells that their bounds touch and meet in an equi join. No
    name ties a region to a raster.
    """
    corners = ("x1", "y1", "x2", "y2")
    shaped = with_once(regions, {"r_ring": rings.planar(rings.unwrapped(F.col("coords")))})
    bounded = with_once(shaped, dict(zip([f"r_{n}" for n in corners], rings.bounds(F.col("r_ring")))))
    bounded = bounded.select(*keys, *[f"r_{n}" for n in corners])
    outlines = bounds_center(frames.where(is_supported(F.col("epsg"))), ["raster_id"])
    named = zip(("lon_min", "lat_min", "lon_max", "lat_max"), corners)
    offered = outlines.select("raster_id", *[F.col(a).alias(f"f_{n}") for a, n in named])
    cells = ["cell_x", "cell_y"]
    met = to_cells(bounded, "r_", cell).join(to_cells(offered, "f_", cell), cells)
    turn = F.round((F.col("r_x1") + F.col("r_x2") - F.col("f_x1") - F.col("f_x2")) / 720.0) * 360.0
    theirs = [F.col("f_x1") + turn, F.col("f_y1"), F.col("f_x2") + turn, F.col("f_y2")]
    return met.where(rings.bounds_overlap(rings.box_of("r_"), theirs)).select(*keys, "raster_id").distinct()


def placed(chosen: DataFrame, frames: DataFrame) -> DataFrame:
    """``chosen`` (raster_id, coords, ...) with frames on their lattice and ``ring`` in its rows and columns.

    Rasters that hold no pixel of the ring's bounds are dropped.
    """
    met = chosen.join(on_lattice(frames), "raster_id")
    planar = with_once(met, {"planar": rings.ring_to_crs(F.col("coords"), F.col("epsg"))})
    ring = rings.ring_to_pixels(F.col("planar"), F.col("lattice_x0"), F.col("lattice_y0"), F.col("px"), F.col("py"))
    shaped = with_once(planar.select("*", ring.alias("ring")).drop("planar"), _snapped(F.col("ring")))
    touches = (
        (F.col("west") < F.col("col0") + F.col("width"))
        & (F.col("east") > F.col("col0"))
        & (F.col("north") < F.col("row0") + F.col("height"))
        & (F.col("south") > F.col("row0"))
    )
    return shaped.where(touches)


def _snapped(ring: Column) -> dict[str, Column]:
    """Bounds of a ring in pixels, snapped outward: first column and row, and one beyond the last."""
    x_min, y_min, x_max, y_max = rings.bounds(ring)
    return {"west": F.floor(x_min), "north": F.floor(y_min), "east": F.ceil(x_max), "south": F.ceil(y_max)}


def with_windows(found: DataFrame, keys: Sequence[str], order: Sequence[str], slots: int = 1) -> DataFrame:
    """Placed rasters with the crop window of their region; those that take no part are dropped.

    A region (``keys``) lies on the lattice of its first raster in ``order``; rasters off it would need
    resampling. ``slot`` (0, 1, ..) names sets of rasters that must all be there. The window is the ring's bounds
    inside the box around the rasters of every slot; regions without a slot, or with an empty window, have none.
    """
    whole = Window.partitionBy(*keys)
    first = F.first("lattice").over(whole.orderBy(*order))
    near = found.withColumn("_first", first).where("lattice = _first").drop("_first")
    boxes = {"_top": F.min("row0"), "_bottom": F.max(F.col("row0") + F.col("height")), "_left": F.min("col0"), "_right": F.max(F.col("col0") + F.col("width"))}
    of_slot = Window.partitionBy(*keys, "slot")
    boxed = near.withColumns({n: c.over(of_slot) for n, c in boxes.items()})
    limits = {
        "_found": F.size(F.collect_set("slot").over(whole)),
        "col_min": F.greatest(F.col("west"), F.max("_left").over(whole)),
        "col_max": F.least(F.col("east"), F.min("_right").over(whole)) - 1,
        "row_min": F.greatest(F.col("north"), F.max("_top").over(whole)),
        "row_max": F.least(F.col("south"), F.min("_bottom").over(whole)) - 1,
    }
    sized = boxed.withColumns(limits).where((F.col("_found") == slots) & F.expr("col_min <= col_max and row_min <= row_max"))
    return sized.drop("_found", *boxes, "west", "east", "north", "south")


def windows_of(sources: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per region with its ring, lattice, window and the frame of the cropped rectangle."""
    names = ["ring", *LATTICE, "row_min", "row_max", "col_min", "col_max", *carry]
    return (
        sources.groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in names])
        .withColumns(
            {
                "crop_x0": F.col("lattice_x0") + F.col("col_min") * F.col("px"),
                "crop_y0": F.col("lattice_y0") - F.col("row_min") * F.col("py"),
                "crop_width": F.col("col_max") - F.col("col_min") + 1,
                "crop_height": F.col("row_max") - F.col("row_min") + 1,
            }
        )
    )


def _pixels_on_lattice(pixels: DataFrame, near: DataFrame) -> DataFrame:
    """Pixels of the raster tiles in ``near``, addressed on the lattice; the others are dropped before they move."""
    if "tile_row" not in pixels.columns:
        pixels = pixels.withColumn("tile_row", floor_div(F.col("row"), bitrows.TILE_ROWS))
    first = F.greatest(F.col("row_min") - F.col("row0"), F.lit(0))
    last = F.least(F.col("row_max") - F.col("row0"), F.col("height") - 1)
    tiles = near.where(first <= last).withColumn(
        "tile_row", F.explode(F.sequence(floor_div(first, bitrows.TILE_ROWS), floor_div(last, bitrows.TILE_ROWS)))
    )
    on, zone = ["raster_id", "tile_row"], zone_name(["raster_id"])
    if zone in pixels.columns:  # stored by write_raster: other folders are not opened
        left = F.greatest(F.col("col_min") - F.col("col0"), F.lit(0))
        right = F.least(F.col("col_max") - F.col("col0"), F.col("width") - 1)
        zones = zones_of_window(["raster_id"], F.col("tile_row"), bitrows.TILE_ROWS, left, right)
        tiles, on = tiles.where(left <= right).withColumn(zone, F.explode(zones)), [*on, zone]
    tiles = tiles.select(*on, "lattice", "row0", "col0").repartition(*on).distinct()
    met = pixels.join(tiles, on)
    return met.withColumns({"row": F.col("row") + F.col("row0"), "col": F.col("col") + F.col("col0")}).drop("tile_row", zone, "row0", "col0")


def cut(
    pixels: DataFrame, windows: DataFrame, sources: DataFrame, keys: Sequence[str], halo: int, values: Sequence[str], slots: int = 1
) -> DataFrame:
    """The windows' pixels from their sources (``with_windows``): keys, word address, row, col, ``rank`` and the values by slot.

    Every pixel comes from the source of least ``rank`` that has it, missing values included; ``v_i`` is value
    v of slot i, null where no source of the slot has the pixel, and values outside the ring are 0.

    Pixels are laid out once, by lattice address; burned masks meet them there, and the choice between the
    sources groups on a superset of that key, so nothing moves again and no raster or lattice is a key alone.
    """
    layout = ["lattice", *bitrows.ADDRESS]
    dealt = bitrows.with_address(_pixels_on_lattice(pixels, sources), halo).repartition(*layout)
    masks = burn(windows, keys, halo, ["lattice"])
    core = bitrows.core_width(halo)
    wanted = sources.select(*keys, "slot", "raster_id", "rank", "row0", "col0", "width", "height")
    first_word = floor_div(F.col("col0"), core)
    last_word = floor_div(F.col("col0") + F.col("width") - 1, core)
    asked = (
        masks.join(wanted, list(keys))
        .where(F.col("row").between(F.col("row0"), F.col("row0") + F.col("height") - 1) & F.col("word").between(first_word, last_word))
        .drop("row0", "col0", "width", "height")
        .repartition(*layout)
    )
    clipped = clip(dealt, asked, ["lattice", "raster_id"], halo, values)
    picked = [
        F.min(F.when(F.col("slot") == i, _ranked(F.col(v)))).alias(f"{v}_{i}") for i in range(slots) for v in values
    ]
    grouped = clipped.groupBy("lattice", *bitrows.ADDRESS, "col", *keys).agg(
        *picked, F.max("inside").alias("inside"), *[F.min(F.when(F.col("slot") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(slots)]
    )
    return grouped.withColumns({f"{v}_{i}": _value(F.col(f"{v}_{i}")) for i in range(slots) for v in values})


def written(table: DataFrame, path: str) -> DataFrame:
    """A small table that many parts of a plan read, stored once."""
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _ranked(value: Column) -> Column:
    """A rank and the value that came with it as one number, which sorts by rank."""
    known = F.coalesce(value.cast("long") + F.lit(_ZERO), F.lit(0).cast("long"))
    return F.call_function("shiftleft", F.col("rank").cast("long"), F.lit(_VALUE_BITS)) + known


def _value(ranked: Column) -> Column:
    low = ranked.bitwiseAND(F.lit((1 << _VALUE_BITS) - 1))
    return F.when(low != 0, (low - F.lit(_ZERO)).cast("int"))


def clip_mosaic(
    regions: DataFrame, pixels: DataFrame, frames: DataFrame, key: str, values: Sequence[str], order: Sequence[str] = ("raster_id",), halo: int = 4, path: str | None = None
) -> DataFrame:
    """Each region (``key``, lon/lat ring ``coords``) cut out of all rasters that it lies on.

    Where rasters overlap, a pixel is that of the first in ``order`` (columns of ``frames``). Returns key, row
    and col from the window's corner, inside, rank (place in the order of the raster that the pixel is from),
    and the values. A region without a raster has no rows; rasters off the first one's lattice are not used. With
    ``path``, a new folder that all executors share, the small table of regions and rasters is written there first.
    """
    found = rasters_in_reach(regions, frames, [key])
    chosen = found.join(regions.select(key, "coords"), key).withColumn("slot", F.lit(0))
    near = with_windows(placed(chosen, frames), [key], order)
    turn = Window.partitionBy(key).orderBy(*order)
    sources = near.withColumn("rank", F.row_number().over(turn))
    sources = sources if path is None else written(sources, path)
    windows = windows_of(sources, [key])
    got = cut(pixels, windows, sources, [key], halo, values)
    corner = windows.select(key, "row_min", "col_min")
    return got.join(corner, key).select(
        key,
        (F.col("row") - F.col("row_min")).alias("row"),
        (F.col("col") - F.col("col_min")).alias("col"),
        "inside",
        F.col("rank_0").alias("rank"),
        *[F.col(f"{v}_0").alias(v) for v in values],
    )
