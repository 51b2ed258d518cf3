import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.operators import bands, bitrows, metrics, morphology, regions
from terradelta.plans.detect import detect_changes
from terradelta.plans.legacy import detect_changes_legacy
from terradelta.schemas import PIXELS, RASTER_META, REQUESTS
from terradelta.sources import rasters, sinks
from terradelta.sources.aoi_library import aoi_library
from verification import fixtures as fx

GOLDEN_COLUMNS = ["total_pixels", "changed_pixels", "vegetation_pixels", "water_pixels", "construction_pixels"]


def counts(pixels, steps):
    halo = morphology.halo_of(steps)
    words = bitrows.pack(pixels, ["aoi_id"], bands.change_flags(), halo)
    words = morphology.transform_words(words, ["aoi_id"], ["mask"], steps, ["vegetation", "water"])
    got = metrics.count_words(words, ["aoi_id"])
    return {r.aoi_id: tuple(r[c] for c in GOLDEN_COLUMNS) for r in got.collect()}


def test_golden_counts(spark):
    px = fx.pixels(spark, "/root/testdata/sf0.01")
    got = counts(px, morphology.cleaning(3))
    assert got == {
        "site0": (2500, 1158, 584, 579, 349),
        "site1": (2500, 1457, 714, 669, 366),
        "site2": (2500, 1267, 619, 682, 311),
        "site3": (2500, 1459, 718, 767, 415),
    }
    one = px.withColumn("row", F.substring("aoi_id", 5, 9).cast("long") * 25 + F.col("row"))
    whole = counts(one.withColumn("aoi_id", F.lit("all")), morphology.cleaning(3))
    assert whole == {"all": (10000, 5373, 2640, 2708, 1459)}


def test_golden_clipped_counts(spark):
    sf = "/root/testdata/sf0.01"
    placed = regions.place_planar_rings(fx.planar_regions(spark, sf))
    masks = regions.burn(regions.touching(regions.crop_window(placed)), ["aoi_id"], 4)
    px = bitrows.with_address(fx.pixels(spark, sf), 4)
    values = [f"{b}_{i}" for b in fx.BANDS for i in (1, 2)]
    clipped = regions.clip(px, masks, ["aoi_id"], 4, values)
    assert clipped.agg(F.sum("inside")).collect()[0][0] == 4 * 1892
    assert counts(clipped, morphology.cleaning(3)) == {
        "site0": (2116, 824, 420, 366, 235),
        "site1": (2116, 1073, 461, 482, 363),
        "site2": (2116, 1112, 544, 598, 273),
        "site3": (2116, 1023, 468, 456, 330),
    }


@pytest.fixture(scope="module")
def site(spark):
    """One 20 x 60 raster with a changed patch, three dates, and a polygon around its middle."""
    rows = []
    for day, lift in ((date(2024, 1, 1), 0), (date(2025, 1, 1), 900), (date(2026, 1, 1), 0)):
        for r in range(20):
            for c in range(60):
                patch = lift if 5 <= r < 12 and 10 <= c < 30 else 0
                for band, dn in zip(bands.BANDS, (500, 600, 550, 2400)):
                    extra = patch * 3 if band == "B08" else patch
                    rows.append(("s", day, band, r, c, dn + extra))
    meta = [("s", 32643, 379290.0, 2050820.0, 10.0, 10.0, 60, 20)]
    ring = [[73.8562, 18.5446], [73.8622, 18.5446], [73.8622, 18.5427], [73.8562, 18.5427], [73.8562, 18.5446]]
    req = [
        (1, "s", "2024-01-01", "2025-01-01", ring),
        (2, "s", "2024-01-01", "2025-01-01", ring),
        (3, "s", "2024-01-01", "2024-01-01", ring),
        (4, "s", "2024-01-01", "2026-01-01", ring),
        (5, "s", "2024-01-01", "2030-01-01", ring),
        (6, "elsewhere", "2024-01-01", "2025-01-01", None),
    ]
    return detect_changes(
        spark.createDataFrame(req, REQUESTS),
        spark.createDataFrame(rows, PIXELS),
        aoi_library(spark),
        spark.createDataFrame(meta, RASTER_META),
    )


def test_many_requests_in_one_plan(site):
    got = {r.request_id: r for r in site.metrics().collect()}
    assert set(got) == {1, 2, 3, 4}  # 5 has no scene, 6 no polygon
    assert got[1].asDict() | {"request_id": 0} == got[2].asDict() | {"request_id": 0}
    assert got[1].changed_pixels == 7 * 20 and got[1].total_pixels == 20 * 60
    assert got[1].change_percentage == 11.67 and got[1].changed_area_km2 == 0.01
    assert got[3].changed_pixels == got[4].changed_pixels == 0
    assert [r.request_id for r in site.rejected.collect()] == [6]
    assert site.words.where("bit_count(present) = 0").count() == 0


def test_results_of_materialized_masks_are_the_same(site, tmp_path):
    stored = site.materialized(str(tmp_path / "words"))
    assert stored.words.inputFiles()
    assert stored.metrics().exceptAll(site.metrics()).count() == 0


def test_points_lie_in_the_patch(site):
    points = site.points(k=9).collect()
    assert points and all(5 <= p.row < 12 and 10 <= p.col < 30 for p in points)


def test_documents_are_nested_and_written(spark, site, tmp_path):
    documents = site.documents("http://h/outputs").cache()
    row = documents.where("request_id = 1").collect()[0]
    assert row.raw_image_url == "http://h/outputs/processed/s/rgb_date1_s_2024-01-01.png"
    assert row.map_url.endswith("interactive_map_s_2025-01-01.html")
    sinks.write_metrics(documents, str(tmp_path / "m"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "m")).collect()]
    one = next(x for x in lines if x["request_id"] == 1)
    assert set(one["classification"]) == {"new_construction_km2", "vegetation_loss_km2", "surface_water_km2"}
    assert one["changed_pixels"] == 140
    summary = metrics.result_summary(documents).where("request_id = 1").collect()[0]
    assert summary.title == "S"


def test_raster_sink_round_trip(spark, sf_dir, tmp_path):
    dated = fx.dated(spark, sf_dir)
    path = str(tmp_path / "r")
    rasters.write_raster(dated, path, "bands", rows_per_part=8)
    back = rasters.read_raster(spark, path)
    columns = ["aoi_id", "scene_date", "row", "col", *fx.BANDS]
    assert back.select(*columns).exceptAll(dated.select(*columns)).count() == 0
    assert back.count() == dated.count()


def test_long_and_wide_bands_agree(spark, sf_dir):
    dated = fx.dated(spark, sf_dir)
    columns = ["aoi_id", "scene_date", "row", "col", *fx.BANDS]
    again = bands.stack_bands(bands.unstack_bands(dated))
    assert again.select(*columns).exceptAll(dated.select(*columns)).count() == 0


def test_placeholder_for_missing_rasters(spark):
    have = spark.createDataFrame([("a", 0, 0, 1, 2, 3)], "k string, row bigint, col bigint, red int, green int, blue int")
    want = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    got = rasters.with_placeholder(want, have, ["k"], height=3, width=4).collect()
    assert len(got) == 1 + 12
    assert {tuple(r)[3:] for r in got if r.k == "b"} == {(15, 32, 67)}


def test_legacy_identical_and_different_images(spark):
    rng = np.random.default_rng(6)
    size = (30, 40)
    one = rng.integers(0, 100, (*size, 3))
    two = one.copy()
    two[8:20, 5:25] += 120
    schema = "aoi_id string, row bigint, col bigint, red int, green int, blue int"

    def image(a):
        return spark.createDataFrame(
            [("a", r, c, *map(int, a[r, c])) for r in range(size[0]) for c in range(size[1])], schema
        )

    sizes = spark.createDataFrame(
        [("a", 40, 30, 40, 30)],
        "aoi_id string, src_width bigint, src_height bigint, dst_width bigint, dst_height bigint",
    )
    same = detect_changes_legacy(image(one), image(one), sizes).collect()[0]
    assert (same.total_pixels, same.changed_pixels, same.change_percentage) == (1200, 0, 0.0)
    got = detect_changes_legacy(image(one), image(two), sizes).collect()[0]
    assert (got.changed_pixels, got.change_percentage, got.changed_area_km2) == (240, 20.0, 0.024)
