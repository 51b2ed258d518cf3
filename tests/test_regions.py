import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.functions import rings
from terradelta.functions.utm import from_utm, to_utm
from terradelta.operators import bitrows, regions
from tests import helpers as h

META = [("a", 32643, 1000.0, 9000.0, 10.0, 10.0, 140, 40)]
META_SCHEMA = (
    "aoi_id string, epsg int, x0 double, y0 double, px double, py double, width bigint, height bigint"
)


def windows(spark, ring):
    """Crop window of a ring given in (col, row) coordinates."""
    points = [(1000.0 + 10 * x, 9000.0 - 10 * y) for x, y in ring]
    df = spark.createDataFrame(META, META_SCHEMA).withColumn(
        "planar_ring",
        F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points]),
    )
    return regions.crop_window(regions.place_planar_rings(df))


def star(rng, n, cx, cy, radius):
    """A closed, usually concave ring around a centre."""
    angles = np.sort(rng.random(n)) * 2 * math.pi
    reach = radius * (0.3 + 0.7 * rng.random(n))
    ring = [(cx + 2 * r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, reach)]
    return [*ring, ring[0]]


@pytest.mark.parametrize("seed", range(4))
def test_burned_masks_match_ray_casting(spark, seed):
    ring = star(np.random.default_rng(seed), 9, 70.3, 20.7, 25.0)
    win = regions.touching(windows(spark, ring))
    row = win.collect()[0]
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    assert row.col_min == max(0, math.floor(min(xs))) and row.col_max == min(140, math.ceil(max(xs))) - 1
    assert row.row_min == max(0, math.floor(min(ys))) and row.row_max == min(40, math.ceil(max(ys))) - 1
    px = h.raster(spark, {"a": np.full((40, 140), 7)}, "dn")
    masks = regions.burn(win, ["aoi_id"], 4)
    clipped = regions.clip(bitrows.with_address(px, 4), masks, ["aoi_id"], 4, ["dn"]).collect()
    assert len(clipped) == row.crop_width * row.crop_height
    for p in clipped:
        want = h.inside(ring, p.col + 0.5, p.row + 0.5)
        assert (p.inside, p.dn) == (int(want), 7 * want), (p.row, p.col)


def test_region_beside_its_raster_has_no_window(spark):
    ring = [(-20.0, 3.0), (-10.0, 3.0), (-10.0, 9.0), (-20.0, 3.0)]
    assert regions.touching(windows(spark, ring)).count() == 0


def test_utm_round_trip_and_known_point(spark):
    rows = [(lon, lat, epsg) for epsg, south in ((32643, 0), (32743, 1)) for lon in (72.2, 75.0, 77.9)
            for lat in ((-60.0, -12.5, -0.1) if south else (0.1, 18.5, 79.0))]
    df = spark.createDataFrame(rows, "lon double, lat double, epsg int")
    x, y = to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    there = df.withColumns({"x": x, "y": y})
    lon, lat = from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    for r in there.withColumns({"lon2": lon, "lat2": lat}).collect():
        # the third-order series is good to about a millimetre
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
        if r.lon == 75.0:
            assert abs(r.x - 500000.0) < 1e-6


def test_library_rectangles(spark):
    """Sizes of the built-in areas at 10 m, bounds snapped outward."""
    from terradelta.sources.aoi_library import aoi_library

    ring = rings.ring_to_utm(F.col("coords"), F.lit(32643))
    df = aoi_library(spark).withColumn("planar_ring", ring)
    whole = df.withColumns(
        {
            "x0": F.lit(300000.0), "y0": F.lit(2200020.0), "px": F.lit(10.0), "py": F.lit(10.0),
            "width": F.lit(20000).cast("long"), "height": F.lit(20000).cast("long"),
        }
    )
    got = regions.crop_window(regions.place_planar_rings(whole)).collect()
    sizes = {r.aoi_id: (r.crop_width, r.crop_height) for r in got}
    assert sizes == {
        "hinjewadi": (224, 115),
        "bhosari": (63, 33),
        "rajgurunagar": (508, 273),
        "chakan": (645, 297),
    }


def test_normalize_ring_accepts_both_nestings(spark):
    flat = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]])], "aoi_id string, coords array<array<double>>")
    nested = flat.withColumn("coords", F.array("coords"))
    assert rings.normalize_ring(nested, "coords").collect() == rings.normalize_ring(flat, "coords").collect()
    swapped = flat.select(rings.swap_axes(F.col("coords"))).collect()[0][0]
    assert swapped == [[2.0, 1.0], [4.0, 3.0]]


def crossing(a, b) -> bool:
    """Brute force: polygons share a point (general position)."""

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    for p, q in zip(a, a[1:]):
        for r, s in zip(b, b[1:]):
            if side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0:
                return True
    return h.inside(a, *b[0]) or h.inside(b, *a[0])


def test_polygon_intersection_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    pairs = []
    for i in range(300):
        a = star(rng, 6, *(rng.random(2) * 10), 1.0 + 4 * rng.random())
        b = star(rng, 5, *(rng.random(2) * 10), 0.5 + 2 * rng.random())
        pairs.append((i, [list(map(float, p)) for p in a], [list(map(float, p)) for p in b]))
    df = spark.createDataFrame(pairs, "i int, a array<array<double>>, b array<array<double>>")
    df = rings.with_shape(df, rings.planar(F.col("a")), "a_")
    df = rings.with_shape(df, rings.planar(F.col("b")), "b_")
    got = {r[0]: r[1] for r in df.select("i", rings.shapes_meet("a_", "b_")).collect()}
    want = {i: crossing(a, b) for i, a, b in pairs}
    assert got == want and 0 < sum(want.values()) < 300


@pytest.mark.parametrize(
    "other, hit",
    [
        ([(2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (2.0, 0.0)], True),  # touches a corner
        ([(1.0, 2.0), (3.0, 4.0), (0.0, 4.0), (1.0, 2.0)], True),  # a vertex on an edge
        ([(0.5, 0.5), (0.6, 0.5), (0.6, 0.6), (0.5, 0.5)], True),  # within
        ([(-9.0, -9.0), (9.0, -9.0), (0.0, 20.0), (-9.0, -9.0)], True),  # around
        ([(2.1, 0.0), (3.0, 0.0), (3.0, 1.0), (2.1, 0.0)], False),
        ([(1.9, 2.3), (2.3, 1.9), (2.4, 2.4), (1.9, 2.3)], False),  # bounds overlap only
    ],
)
def test_intersection_is_closed(spark, other, hit):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame(
        [([list(p) for p in square], [list(p) for p in other])], "a array<array<double>>, b array<array<double>>"
    )
    df = rings.with_shape(df, rings.planar(F.col("a")), "a_")
    df = rings.with_shape(df, rings.planar(F.col("b")), "b_")
    assert df.select(rings.shapes_meet("a_", "b_"), rings.shapes_meet("b_", "a_")).collect()[0] == (hit, hit)
