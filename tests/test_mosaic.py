"""Polygons over several rasters, common grids, seams and long borders, against plain Python."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from terradelta.functions import projection, rings
from terradelta.operators import bitrows, mosaic, regions, sampling, scenes
from terradelta.plans import incremental
from terradelta.plans.detect import detect_changes
from terradelta.plans.from_catalog import NO_RASTER, detect_from_catalog
from tests.helpers import inside

FRAME = "raster_id bigint, epsg int, x0 double, y0 double, px double, py double, width bigint, height bigint"
GEO = [  # degrees, pixels of a hundredth; the second overlaps the first by four columns, the third is half a pixel off
    (1, 4326, 10.0, 50.0, 0.01, 0.01, 12, 10),
    (2, 4326, 10.08, 49.98, 0.01, 0.01, 12, 10),
    (3, 4326, 10.005, 50.0, 0.01, 0.01, 12, 10),
    (4, 2154, 10.0, 50.0, 0.01, 0.01, 12, 10),
]
RING = [[10.0211, 49.9893], [10.1731, 49.9621], [10.1503, 49.9107], [10.0307, 49.9219], [10.0211, 49.9893]]


def pixels(spark, frames, value=lambda i, r, c: 100 * i + 10 * r + c):
    rows = [(f[0], r, c, value(f[0], r, c)) for f in frames for r in range(f[7]) for c in range(f[6])]
    return spark.createDataFrame(rows, "raster_id bigint, row bigint, col bigint, b02 int")


def plain_mosaic(ring, frames, order):
    """Rows (row, col, inside, place in the order, value) by pixel centres, for rasters in degrees."""
    used = [f for f in sorted(frames, key=order)]
    left, top = frames[0][2], frames[0][3]
    at = [((x - left) / 0.01, (top - y) / 0.01) for x, y in ring]
    boxes = [(round((f[2] - left) / 0.01), round((top - f[3]) / 0.01), f[6], f[7]) for f in used]
    c0 = max(math.floor(min(x for x, _ in at)), min(b[0] for b in boxes))
    c1 = min(math.ceil(max(x for x, _ in at)), max(b[0] + b[2] for b in boxes)) - 1
    r0 = max(math.floor(min(y for _, y in at)), min(b[1] for b in boxes))
    r1 = min(math.ceil(max(y for _, y in at)), max(b[1] + b[3] for b in boxes)) - 1
    out = []
    for r in range(r0, r1 + 1):
        for c in range(c0, c1 + 1):
            for rank, (f, (bc, br, w, h)) in enumerate(zip(used, boxes), 1):
                if 0 <= c - bc < w and 0 <= r - br < h:
                    hit = inside(at, c + 0.5, r + 0.5)
                    out.append((r - r0, c - c0, int(hit), rank, 100 * f[0] + 10 * (r - br) + c - bc if hit else 0))
                    break
    return out


@pytest.mark.parametrize("down", [False, True])
def test_mosaic_of_two_rasters(spark, down):
    frames = spark.createDataFrame(GEO, FRAME).withColumn("turn", F.col("raster_id") * (-1 if down else 1))
    shape = spark.createDataFrame([("a", RING), ("far", [[x + 90, y] for x, y in RING])], "name string, coords array<array<double>>")
    some = frames.where("raster_id <> 3")  # 4 has no known CRS
    got = mosaic.clip_mosaic(shape, pixels(spark, GEO), some, "name", ["b02"], ["turn"])
    rows = [tuple(r)[1:] for r in got.collect() if r["name"] == "a"]
    assert sorted(rows) == plain_mosaic(RING, GEO[:2], lambda f: -f[0] if down else f[0]) and got.count() == len(rows)


def test_rasters_off_the_first_lattice_are_not_used(spark):
    frames = spark.createDataFrame(GEO, FRAME)
    shape = spark.createDataFrame([("a", RING)], "name string, coords array<array<double>>")
    got = mosaic.clip_mosaic(shape, pixels(spark, GEO), frames, "name", ["b02"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == plain_mosaic(RING, GEO[:2], lambda f: f[0])


def test_a_missing_value_of_the_first_raster_stays_missing(spark):
    frames = spark.createDataFrame(GEO[:2], FRAME)
    shape = spark.createDataFrame([("a", RING)], "name string, coords array<array<double>>")
    px = pixels(spark, GEO[:2]).withColumn("b02", F.when((F.col("raster_id") != 1) | (F.col("row") != 5), F.col("b02") - 300))
    for r in mosaic.clip_mosaic(shape, px, frames, "name", ["b02"]).collect():
        first_row = r["row"] + 1 == 5 and r["rank"] == 1  # the window begins at row 1
        assert (r["b02"] is None) == first_row
    assert mosaic.clip_mosaic(shape, px.limit(0), frames, "name", ["b02"]).count() == 0
    assert mosaic.clip_mosaic(shape, px, frames.limit(0), "name", ["b02"]).count() == 0


def test_frames_and_rings_across_the_seam(spark):
    frames = [(1, 4326, 179.9, 10.0, 0.01, 0.01, 20, 10), (2, 32601, 166021.0 - 5000, 1100000.0, 100.0, 100.0, 150, 100)]
    ring = [[179.95, 9.99], [-179.93, 9.99], [-179.93, 9.93], [179.95, 9.93], [179.95, 9.99]]
    shape = spark.createDataFrame([("a", ring), ("b", [[0.0, 9.9], [0.1, 9.9], [0.1, 9.8], [0.0, 9.9]])], "name string, coords array<array<double>>")
    reach = mosaic.rasters_in_reach(shape, spark.createDataFrame(frames, FRAME), ["name"])
    assert sorted(map(tuple, reach.collect())) == [("a", 1), ("a", 2)]


def test_scene_search_across_the_seam(spark):
    def box(x1, x2):
        return [[x1, 0.0], [x2, 0.0], [x2, 2.0], [x1, 2.0], [x1, 0.0]]

    asked = spark.createDataFrame([("across", box(179.5, -179.5)), ("west", box(-179.9, -179.6)), ("east", box(179.0, 179.4))], "aoi_id string, coords array<array<double>>")
    asked = asked.withColumn("target_date", F.lit("2024-05-05").cast("date"))
    offered = [(1, box(179.6, 179.9)), (2, box(-179.8, -178.0)), (3, box(178.0, 179.2)), (4, box(179.7, -179.7)), (5, box(-1.0, 1.0))]
    catalog = spark.createDataFrame(offered, "product_id bigint, footprint array<array<double>>").select(
        "product_id", F.lit("2024-05-05 10:00:00").cast("timestamp_ntz").alias("sensing_start"), F.lit("S2MSI2A").alias("product_type"), F.lit(1.0).alias("cloud_cover"), "footprint"
    )
    found = {}
    for r in scenes.top_scenes(asked, catalog).collect():
        found.setdefault(r["aoi_id"], set()).add(r["product_id"])
    assert found == {"across": {1, 2, 4}, "west": {2, 4}, "east": {3}}


def test_wide_rings_are_not_taken_for_crossing(spark):
    ring = [[float(x), 0.0] for x in range(-170, 171, 20)] + [[float(x), 9.0] for x in range(170, -171, -20)] + [[-170.0, 0.0]]
    df = spark.createDataFrame([(ring,), ([[179.0, 0.0], [-179.0, 0.0], [-179.0, 1.0], [179.0, 0.0]],), ([],)], "c array<array<double>>")
    got = [r[0] for r in df.select(rings.unwrapped(F.col("c"))).collect()]
    assert got == [ring, [[179.0, 0.0], [181.0, 0.0], [181.0, 1.0], [179.0, 0.0]], []]


def test_border_of_ten_thousand_points(spark):
    rng = random.Random(5)
    turns = [2 * math.pi * i / 10_000 for i in range(10_000)]
    ring = [(300 + (200 + rng.random() * 60) * math.cos(t), 700 + (500 + rng.random() * 60) * math.sin(t)) for t in turns]
    ring.append(ring[0])
    df = spark.createDataFrame([("a", ring)], "aoi_id string, ring array<struct<x:double,y:double>>")
    frame = {"width": 600, "height": 1400, "x0": 0.0, "y0": 0.0, "px": 1.0, "py": 1.0}
    window = regions.crop_window(df.withColumns({n: F.lit(v).cast("long" if isinstance(v, int) else "double") for n, v in frame.items()}))
    burned = regions.burn(window, ["aoi_id"], 4)
    got = {r["row"]: r["n"] for r in burned.groupBy("row").agg(F.sum(F.bit_count("inside")).alias("n")).collect()}
    for row in range(min(got), max(got) + 1, 7):
        y = row + 0.5
        at = sorted((x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:]) if (y1 > y) != (y2 > y))
        cuts = [min(max(math.ceil(x - 0.5), 0), 600) for x in at]
        assert got[row] == sum(b - a for a, b in zip(cuts[::2], cuts[1::2]))
    assert bitrows.core_width(4) == 56


def test_projections_round_trip_and_reject(spark):
    rows = [(10.5, 45.25, 32632), (10.5, -45.25, 32732), (10.5, 45.25, 4326), (-179.5, 80.0, 3857), (10.5, 45.25, 2154), (10.5, 45.25, 32661), (1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "lon double, lat double, epsg int")
    x, y = projection.to_crs(F.col("lon"), F.col("lat"), F.col("epsg"))
    there = df.withColumns({"x": x, "y": y})
    lon, lat = projection.from_crs(F.col("x"), F.col("y"), F.col("epsg"))
    for r, got in zip(rows, there.withColumns({"lon2": lon, "lat2": lat}).collect()):
        known = r[2] in (32632, 32732, 4326, 3857)
        assert (got["x"] is not None) == (got["lat2"] is not None) == known
        if known:
            assert got["lon2"] == pytest.approx(r[0], abs=1e-8) and got["lat2"] == pytest.approx(r[1], abs=1e-8)


def test_ranks_on_one_row_of_a_million_pixels(spark):
    px = spark.range(1_000_000).select(F.lit("a").alias("aoi_id"), F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), (F.col("id") % 3 == 1).alias("hit"))
    words = bitrows.pack(px, ["aoi_id"], {"bits": F.col("hit")}, 1)
    ranked = sampling.rank_words(words.where("bits != 0"), ["aoi_id"])
    got = sampling.rank_pixels(ranked, ["aoi_id"], 1)
    bad = got.where((F.col("rank") * 3 + 1 != F.col("col")) | (F.col("n") != 333_333))
    assert got.count() == 333_333 and bad.isEmpty()


def test_a_second_run_reads_no_pixel(spark, tmp_path):
    requests, wide, aois, _, frames = catalog_case(spark)
    one = wide.where("raster_id IN (10, 20)").select(
        F.lit("t").alias("aoi_id"), F.when(F.col("raster_id") == 10, F.lit("2024-01-03")).otherwise(F.lit("2024-06-10")).cast("date").alias("scene_date"), "row", "col", "b02", "b03", "b04", "b08"
    )
    one.write.parquet(str(tmp_path / "pixels"))
    stored = spark.read.parquet(str(tmp_path / "pixels"))
    meta = frames.where("raster_id = 10").withColumnRenamed("raster_id", "aoi_id").withColumn("aoi_id", F.lit("t"))
    ring = [[10.0, 50.0], [10.1, 50.0], [10.1, 49.9], [10.0, 49.9], [10.0, 50.0]]
    half = [[10.0, 50.0], [10.049, 50.0], [10.049, 49.9], [10.0, 49.9], [10.0, 50.0]]
    asked = [(1, "t", "2024-01-03", "2024-06-10", ring), (2, "t", "2024-01-03", "2024-06-10", ring), (3, "t", "2024-01-03", "2024-01-04", ring)]
    kind = "request_id bigint, aoi_id string, date1 string, date2 string, coords array<array<double>>"
    first = spark.createDataFrame(asked, kind)
    out = str(tmp_path / "out")
    assert incremental.run_pending(first, stored, aois, meta, out) == 2
    rows = spark.read.parquet(f"{out}/metrics").collect()
    assert [(r["total_pixels"], r["date2"].isoformat()) for r in rows] == [(100, "2024-06-10")]
    assert incremental.run_pending(first, stored, aois, meta, out) == 1  # the one without pixels of its second date
    again = spark.createDataFrame(asked[:2], kind)
    shutil.move(str(tmp_path / "pixels"), str(tmp_path / "gone"))
    assert incremental.run_pending(again, stored, aois, meta, out) == 0
    shutil.move(str(tmp_path / "gone"), str(tmp_path / "pixels"))
    more = spark.createDataFrame([*asked[:2], (4, "t", "2024-01-03", "2024-06-10", half)], kind)
    assert incremental.run_pending(more, stored, aois, meta, out) == 1
    assert sorted(r["total_pixels"] for r in spark.read.parquet(f"{out}/metrics").collect()) == [50, 100]
    assert spark.read.parquet(f"{out}/manifest").count() == 2


def catalog_case(spark):
    """Two adjacent rasters a date, an odd raster, and requests served, without a scene, and beside all rasters."""
    day = {1: "2024-01-03", 2: "2024-06-10"}
    frames, offered, px = [], [], []
    for d in (1, 2):
        for k in (0, 1):
            i = 10 * d + k
            frames.append((i, 4326, 10.0 + 0.1 * k, 50.0, 0.01, 0.01, 10, 10))
            offered.append((i, day[d], 5.0 + k, [[9.9, 49.8], [10.3, 49.8], [10.3, 50.1], [9.9, 50.1], [9.9, 49.8]]))
            for r in range(10):
                for c in range(10):
                    new = d == 2 and 3 <= r <= 6 and (c >= 6 if k == 0 else c <= 3)
                    px.append((i, r, c, *((1200, 1300, 1250, 5400) if new else (500, 600, 550, 2400))))
    catalog = spark.createDataFrame(offered, "product_id bigint, day string, cloud_cover double, footprint array<array<double>>").select(
        "product_id", F.col("day").cast("timestamp_ntz").alias("sensing_start"), F.lit("S2MSI2A").alias("product_type"), "cloud_cover", "footprint"
    )
    ring = [[10.03, 49.98], [10.17, 49.98], [10.17, 49.92], [10.03, 49.92], [10.03, 49.98]]
    beside = [[10.25, 49.95], [10.29, 49.95], [10.29, 49.85], [10.25, 49.95]]
    asked = [(1, "x", "2024-01-01", "2024-06-13", ring), (1, "y", "2024-01-08", "2024-06-05", ring), (None, "x", "2024-01-01", "2024-06-13", ring),
             (3, "x", "2024-03-01", "2024-06-13", ring), (4, "x", "2024-03-01", "2024-09-01", ring), (5, "z", "2024-01-01", "2024-06-10", beside)]
    requests = spark.createDataFrame(asked, "request_id bigint, aoi_id string, date1 string, date2 string, coords array<array<double>>")
    wide = spark.createDataFrame(px, "raster_id bigint, row bigint, col bigint, b02 int, b03 int, b04 int, b08 int")
    aois = spark.createDataFrame([("lib", ring, ("2024-01-01", "2024-06-01"))], "aoi_id string, coords array<array<double>>, default_dates struct<date1:string,date2:string>")
    return requests, wide, aois, catalog, spark.createDataFrame(frames, FRAME)


def test_detection_on_scenes_days_off(spark):
    found = detect_from_catalog(*catalog_case(spark))
    rows = {(r["request_id"], r["aoi_id"]): (r["total_pixels"], r["changed_pixels"], r["construction_pixels"]) for r in found.metrics().collect()}
    assert rows == {(1, "x"): (14 * 6, 48, 48), (1, "y"): (84, 48, 48), (None, "x"): (84, 48, 48)}  # closing fills up to the edge
    why = {(r["request_id"], r["aoi_id"]): r["reason"] for r in found.unserved().collect()}
    assert why == {
        (3, "x"): "no scene within 5 days of 2024-03-01",
        (4, "x"): "no scene within 5 days of 2024-03-01; no scene within 5 days of 2024-09-01",
        (5, "z"): NO_RASTER,
    }
    used = {(r["request_id"], r["date"], r["product_id"], r["rank"]) for r in found.scenes().collect() if r["aoi_id"] == "y"}
    assert used == {(1, 1, 10, 1), (1, 1, 11, 2), (1, 2, 20, 1), (1, 2, 21, 2)}
    points = found.features().collect()
    assert sum("Point" in r["feature"] for r in points) == 2 * 48 and found.masks().count() == 2 * 84
    lons = [float(r["feature"].split('"coordinates":[')[1].split(",")[0]) for r in points if '"type":"Point"' in r["feature"]]
    assert min(lons) == pytest.approx(10.065) and max(lons) == pytest.approx(10.135)


def test_requests_that_share_an_id_keep_their_results(spark):
    day = ["2024-01-03", "2024-06-10"]
    px = [("s", d, r, c, 500 + 900 * (i * (c > 4)), 600, 550, 2400) for i, d in enumerate(day) for r in range(10) for c in range(10)]
    pixels_df = spark.createDataFrame(px, "aoi_id string, day string, row bigint, col bigint, b02 int, b03 int, b04 int, b08 int")
    pixels_df = pixels_df.withColumn("scene_date", F.col("day").cast("date")).drop("day")
    meta = spark.createDataFrame([("s", 4326, 10.0, 50.0, 0.01, 0.01, 10, 10)], FRAME.replace("raster_id bigint", "aoi_id string"))
    whole = [[10.0, 50.0], [10.1, 50.0], [10.1, 49.9], [10.0, 49.9], [10.0, 50.0]]
    half = [[10.0, 50.0], [10.049, 50.0], [10.049, 49.9], [10.0, 49.9], [10.0, 50.0]]
    aois = spark.createDataFrame([("s", whole, (day[0], day[1]))], "aoi_id string, coords array<array<double>>, default_dates struct<date1:string,date2:string>")
    asked = [(7, "s", None, None, None), (7, "s", None, None, half), (None, "s", None, None, half), (None, "s", None, None, None)]
    requests = spark.createDataFrame(asked, "request_id bigint, aoi_id string, date1 string, date2 string, coords array<array<double>>")
    found = detect_changes(requests, pixels_df, aois, meta)
    got = sorted(((r["request_id"], r["total_pixels"], r["changed_pixels"]) for r in found.metrics().collect()), key=repr)
    assert got == sorted([(7, 100, 50), (7, 50, 0), (None, 50, 0), (None, 100, 50)], key=repr)
    odd = detect_changes(requests, pixels_df, aois, meta.withColumn("epsg", F.lit(2154)))
    assert {r["reason"] for r in odd.unserved().collect()} == {"raster CRS is not supported: EPSG 2154"} and odd.metrics().count() == 0
