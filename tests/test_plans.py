"""Shapes of physical plans with broadcasts off, as for tables of any size."""

import re

import pytest

from terradelta.operators import bands, bitrows, metrics, morphology, regions
from terradelta.operators.resize import resize_bilinear
from terradelta.plans.detect import clipped_pairs, detect_changes
from terradelta.plans.legacy import comparison_strip, detect_changes_legacy
from terradelta.plans.scene_plan import plan_scenes
from terradelta.sources import rasters
from verification import fixtures as fx


JOB_KEYS = {"aoi_id, ring_key, date1, date2", "_groupingexpression"}  # of the small table of jobs


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    """Keys of the hash exchanges, without expression ids."""
    found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    return [re.sub(r"#\d+L?", "", keys) for keys in found]


def test_cleaning_and_counting_shuffle_words_only(no_broadcast, sf_dir):
    px = fx.pixels(no_broadcast, sf_dir)
    steps = morphology.cleaning(3)
    words = bitrows.pack(px, ["aoi_id"], bands.change_flags(), morphology.halo_of(steps))
    words = morphology.transform_words(words, ["aoi_id"], ["mask"], steps, ["vegetation", "water"])
    plan = plan_of(metrics.count_words(words, ["aoi_id"]))
    assert exchanges(plan)[::-1] == [
        "aoi_id, tile_row, word, row",  # packed words, after partial aggregation
        "aoi_id, tile_row, word",  # halo
        "aoi_id",  # counts
    ]
    assert len(re.findall(r"\bSort \[", plan)) == 1


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pixels") / "long")
    fx.bands(spark, sf_dir).write.partitionBy("scene_date").parquet(path)
    return path


def test_pixels_are_shuffled_once_until_they_are_packed(no_broadcast, sf_dir, stored):
    spark = no_broadcast
    pixels = rasters.read_pixels(spark, stored)
    found = detect_changes(
        fx.requests(spark, sf_dir), pixels, fx.aois(spark, sf_dir), fx.raster_meta(spark, sf_dir)
    )
    pairs = clipped_pairs(pixels, found.jobs, found.halo)
    words = bitrows.pack(pairs, ["job_id", "aoi_id"], bands.change_flags(), found.halo)
    plan = plan_of(words)
    # one exchange of pixels, one of the burned masks it joins, and the small ones beside them
    assert exchanges(plan).count("aoi_id, tile_row, word, row") == 2
    rest = [e for e in exchanges(plan) if e != "aoi_id, tile_row, word, row"]
    assert set(rest) <= {"aoi_id, scene_date, tile_row", "aoi_id", "job_id, aoi_id, date1, date2, tile_row"} | JOB_KEYS
    assert re.search(r"LeftSemi|left_semi", plan) and "aoi_id, scene_date, tile_row" in rest
    for node in ("CartesianProduct", "NestedLoop", "Python"):
        assert node not in plan
    assert "PushedFilters: [In(band, [B02,B03,B04,B08])" in plan
    assert "dynamicpruning" in plan.lower()


@pytest.mark.parametrize("every_key", ["true", "false"])
def test_pixels_stored_by_tile_never_move_by_raster_alone(no_broadcast, sf_dir, tmp_path, every_key):
    spark, name = no_broadcast, "spark.sql.requireAllClusterKeysForCoPartition"
    rasters.write_raster(fx.dated(spark, sf_dir), str(tmp_path / "stored"), "bands")
    usual = spark.conf.get(name)
    spark.conf.set(name, every_key)
    try:
        found = detect_changes(
            fx.requests(spark, sf_dir), rasters.read_raster(spark, str(tmp_path / "stored")), fx.aois(spark, sf_dir), fx.raster_meta(spark, sf_dir)
        )
        plan = plan_of(found.words)
    finally:
        spark.conf.set(name, usual)
    scans = [part for part in re.split(r"(?=Exchange )", plan) if "b02#" in part and "FileScan" in part]
    assert scans and all(re.match(r"Exchange hashpartitioning\(aoi_id#\d+, scene_date#\d+, (cast\()?tile_row#\d+", part) for part in scans)
    assert "dynamicpruning" in plan.lower()


def test_edges_are_swept_one_by_one(spark, sf_dir):
    windows = regions.crop_window(regions.place_planar_rings(fx.planar_regions(spark, sf_dir)))
    burned = regions.burn(windows, ["aoi_id"], 4)
    plan = burned._jdf.queryExecution().optimizedPlan().toString()
    rows = plan.index("Generate explode")  # the last to unfold
    assert "bit_xor(flipped" in plan and "edges" not in plan[:rows] and "filter(" not in plan
    assert "Generate explode(zip_with(" in plan  # one row for each edge, before rows or words unfold


def test_images_meet_their_sizes_by_blocks_of_rows(no_broadcast, sf_dir):
    spark = no_broadcast
    images = fx.image(spark, sf_dir, 1), fx.small_image2(spark, sf_dir), fx.image_sizes(spark, sf_dir)
    for made in (resize_bilinear(*images[1:], ["red"]), detect_changes_legacy(*images), comparison_strip(*images)):
        plan = plan_of(made)
        moved = [part for part in re.split(r"(?=Exchange )", plan) if "FileScan" in part and "event_id#" in part and "value#" in part]
        assert moved and not [part[:80] for part in moved if re.match(r"Exchange hashpartitioning\(aoi_id#\d+, \d", part)]
        assert exchanges(plan).count("aoi_id, block") >= 2


def test_one_search_finds_all_outcomes(no_broadcast, sf_dir):
    spark = no_broadcast
    plan = plan_scenes(fx.scene_requests(spark, sf_dir), fx.catalog(spark, sf_dir), fx.scenes(spark, sf_dir), fx.manifest(spark, sf_dir))
    for found in (plan.outcome, plan.chosen, plan.unmatched, plan.unlocated, plan.to_fetch):
        assert len(re.findall(r"Join \[day#\d+, cell_x#\d+L?, cell_y", plan_of(found))) == 1


def test_band_scan_reads_only_what_it_needs(spark, stored):
    df = rasters.read_pixels(spark, stored, ["B04"]).where("scene_date = '2024-02-28'").select("dn")
    plan = plan_of(df)
    assert "PartitionFilters: [isnotnull(scene_date" in plan
    assert "ReadSchema: struct<band:string,dn:int>" in plan
