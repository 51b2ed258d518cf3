"""Open rings, rings with holes and broken rings."""

import pytest
from pyspark.sql import functions as F

from terradelta.functions import rings
from terradelta.operators import regions

QUAD = [[4.0, 1.0], [96.0, 2.0], [90.0, 24.0], [10.0, 23.0]]
HOLE = [[40.0, 8.0], [60.0, 8.0], [60.0, 16.0], [40.0, 16.0]]


def burned(spark, coords, kind):
    """Pixels inside a ring given in pixel coordinates of a 100 x 25 raster."""
    df = spark.createDataFrame([("a", coords)], f"aoi_id string, coords {kind}")
    ring = F.transform("coords", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    frame = {"width": F.lit(100).cast("long"), "height": F.lit(25).cast("long"), "x0": F.lit(0.0), "y0": F.lit(0.0), "px": F.lit(1.0), "py": F.lit(1.0)}
    window = regions.crop_window(rings.normalize_ring(df, "coords").withColumn("ring", ring).withColumns(frame))
    return regions.burn(window, ["aoi_id"], 4).agg(F.sum(F.bit_count("inside"))).first()[0]


def test_open_and_closed_rings_are_alike(spark):
    pair = "array<array<double>>"
    whole = burned(spark, [*QUAD, QUAD[0]], pair)
    assert whole > 1500 and burned(spark, QUAD, pair) == whole
    assert burned(spark, [[p + [5.0] for p in QUAD]], f"array<{pair}>") == whole


@pytest.mark.parametrize("close", [True, False])
def test_holes_stay_holes(spark, close):
    border, hole = ([*r, r[0]] if close else r for r in (QUAD, HOLE))
    whole = burned(spark, QUAD, "array<array<double>>")
    assert burned(spark, [border, hole], "array<array<array<double>>>") == whole - 20 * 8


def test_broken_rings(spark):
    rows = [(1, QUAD), (2, QUAD[:2]), (3, [QUAD[0]] * 4), (4, [[1.0, None], *QUAD]), (5, [[1.0], *QUAD]), (6, [None, *QUAD]), (7, [[float("nan"), 1.0], *QUAD]), (8, [])]
    df = rings.normalize_ring(spark.createDataFrame(rows, "id int, coords array<array<double>>"), "coords")
    good = df.select("id", F.coalesce(rings.is_polygon(F.col("coords")), F.lit(False)).alias("ok")).collect()
    assert [r["id"] for r in good if r["ok"]] == [1]
