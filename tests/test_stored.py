"""Stored rasters: zones, the curve inside them, windows, replacing, and detection from them."""

import re
from datetime import date
from glob import glob
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from terradelta.plans.detect import detect_changes
from terradelta.plans.from_catalog import detect_from_catalog
from terradelta.sources import curve, rasters
from tests.test_mosaic import catalog_case
from verification import fixtures as fx
from verification import queries

MASKS = "aoi_id string, scene_date date, row bigint, col bigint, mask int"
ID = ["aoi_id", "scene_date"]
DAY = date(2024, 5, 1)
ZONE = curve.zone_name(ID)


@pytest.fixture
def few_zones(monkeypatch):
    monkeypatch.setattr(curve, "ZONES", 4)


def raster(name, height, width, mask=0, row0=0, col0=0, day=DAY):
    return [(name, day, row0 + r, col0 + c, mask) for r in range(height) for c in range(width)]


def contents(df):
    return sorted((tuple(r) for r in df.select("aoi_id", "scene_date", "row", "col", "mask").collect()), key=str)


def morton(row, col):
    return sum((row >> i & 1) << 2 * i + 1 | (col >> i & 1) << 2 * i for i in range(31))


@pytest.mark.parametrize("far", [0, 1 << 20, (1 << 31) - 64])
def test_pixels_are_sorted_along_the_curve(spark, far):
    cells = [(r, far + c) for r in range(24) for c in range(20)]
    df = spark.createDataFrame(cells, "row bigint, col bigint").repartition(3).coalesce(1)
    got = [tuple(r) for r in curve.along_curve(df, 4, []).collect()]
    assert got == sorted(cells, key=lambda p: (morton(p[0] // 4, p[1] // 4), p))


def test_files_follow_the_data_and_not_the_number_of_rasters(spark, tmp_path, few_zones):
    path = str(tmp_path / "many")
    df = spark.range(3000).select(
        F.concat(F.lit("r"), "id").alias("aoi_id"), F.lit(DAY).alias("scene_date"), F.lit(0).cast("long").alias("row"),
        F.lit(0).cast("long").alias("col"), F.lit(1).alias("mask"),
    )
    rasters.write_raster(df, path, "mask")
    files = glob(f"{path}/*/*.parquet")
    assert len(glob(f"{path}/{ZONE}=*")) == 4 and len(files) == 4
    assert rasters.read_raster(spark, path).count() == 3000


def test_replacing_a_raster_keeps_the_others_and_leaves_nothing_of_it(spark, tmp_path, few_zones):
    path, side = str(tmp_path / "masks"), curve.BLOCK
    spread = [p for i in range(9) for p in raster("wide", 2, 2, 1, row0=i * side)]  # a block in every zone
    others = raster("other", 3, 3, 2) + raster(None, 2, 2, 3) + raster("wide", 2, 2, 4, day=date(2025, 5, 1))
    rasters.write_raster(spark.createDataFrame(spread + others, MASKS), path, "mask")
    assert contents(rasters.read_raster(spark, path)) == sorted(spread + others, key=str)
    # one block where there were nine, a raster without a name, and one that is new
    new = raster("wide", 1, 1, 5) + raster(None, 1, 2, 6) + raster("new", 2, 1, 7)
    rasters.write_raster(spark.createDataFrame(new, MASKS), path, "mask")
    stay = [p for p in others if p[0] is not None]
    assert contents(rasters.read_raster(spark, path)) == sorted(new + stay, key=str)
    rasters.write_raster(spark.createDataFrame(raster("added", 2, 2, 8), MASKS), path, "mask", mode="append")
    rasters.write_raster(spark.createDataFrame([], MASKS), path, "mask")  # replaces nothing
    assert contents(rasters.read_raster(spark, path)) == sorted(new + stay + raster("added", 2, 2, 8), key=str)


def test_zones_that_lose_all_rasters_are_empty(spark, tmp_path, few_zones):
    path, side = str(tmp_path / "one"), curve.BLOCK
    rasters.write_raster(spark.createDataFrame([p for i in range(9) for p in raster("a", 1, 1, 1, col0=i * side)], MASKS), path, "mask")
    rasters.write_raster(spark.createDataFrame(raster("a", 1, 1, 2), MASKS), path, "mask")
    assert contents(rasters.read_raster(spark, path)) == raster("a", 1, 1, 2)


def test_rasters_can_be_replaced_by_what_is_made_of_them(spark, tmp_path):
    path = str(tmp_path / "self")
    rasters.write_raster(spark.createDataFrame(raster("a", 4, 4, 1) + raster("b", 2, 2, 1), MASKS), path, "mask")
    back = rasters.read_raster(spark, path).where("aoi_id = 'a'").withColumn("mask", F.col("mask") + 1)
    rasters.write_raster(back, path, "mask")
    assert contents(rasters.read_raster(spark, path)) == sorted(raster("a", 4, 4, 2) + raster("b", 2, 2, 1), key=str)


def test_a_window_opens_its_zones_and_filters_rows_and_columns_in_the_scan(spark, tmp_path):
    path, edge = str(tmp_path / "window"), curve.BLOCK
    cells = [p for i in (0, 1) for j in (0, 1) for p in raster("a", 30, 30, 1, i * edge - 15 * i, j * edge - 15 * j)]
    rasters.write_raster(spark.createDataFrame(cells + raster("b", 30, 30, 2), MASKS), path, "mask")
    named = {"scene_date": DAY, "aoi_id": "a"}  # in any order
    found = rasters.read_window(spark, path, named, (10, edge + 2), (edge - 3, edge + 1))
    want = [p for p in cells if p[0] == "a" and 10 <= p[2] <= edge + 2 and edge - 3 <= p[3] <= edge + 1]
    assert want and contents(found) == sorted(want, key=str)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = rasters.read_window(spark, path, named, (0, 9), (0, 9))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*)", plan)
    assert re.search(rf"{ZONE}#\d+ (=|IN)", filters[1]) and "xxhash64" not in filters[1]
    assert "GreaterThanOrEqual(row,0)" in filters[2] and "LessThanOrEqual(col,9)" in filters[2]
    whole = rasters.read_window(spark, path, named, (0, 1 << 40), (0, 1 << 40))  # of more blocks than there are zones
    assert contents(whole) == sorted(cells, key=str)


def test_a_large_raster_lies_in_many_zones(spark):
    blocks = spark.range(64).select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("c"), F.col("id").alias("r"))
    zones = blocks.select(curve.zone_of({"aoi_id": F.lit("a")}, F.col("r"), F.col("c")).alias("z")).groupBy("z").count()
    assert zones.count() > 0.95 * curve.ZONES and zones.agg(F.max("count")).first()[0] < 20


def test_detection_from_stored_rasters(spark, sf_dir, tmp_path):
    path, dated = str(tmp_path / "bands"), fx.dated(spark, sf_dir)
    moved = dated.withColumn("col", F.col("col") + curve.BLOCK - 20)  # across the edge of a block
    meta = fx.raster_meta(spark, sf_dir)
    shifted = meta.withColumn("x0", F.col("x0") - (curve.BLOCK - 20) * F.col("px")).withColumn("width", F.col("width") + curve.BLOCK - 20)
    rasters.write_raster(moved, path, "bands")
    given = fx.requests(spark, sf_dir), fx.aois(spark, sf_dir)
    want = detect_changes(given[0], dated, given[1], meta)
    found = detect_changes(given[0], rasters.read_raster(spark, path), given[1], shifted)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found.words._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(rf"PartitionFilters: \[.*dynamicpruningexpression\({ZONE}#", plan)
    names = ["request_id", "total_pixels", "changed_pixels", "vegetation_pixels", "water_pixels", "construction_pixels"]
    got = sorted(map(tuple, found.metrics().select(names).collect()))
    assert got and got == sorted(map(tuple, want.metrics().select(names).collect()))


def test_detection_on_stored_scenes(spark, tmp_path):
    asked, pixels, *rest = catalog_case(spark)
    path = str(tmp_path / "products")
    rasters.write_raster(pixels, path, "bands", ("raster_id",), ())
    found = detect_from_catalog(asked, rasters.read_raster(spark, path), *rest)
    want = detect_from_catalog(asked, pixels, *rest)
    got = sorted(map(str, found.metrics().collect()))
    assert len(got) == 3 and got == sorted(map(str, want.metrics().collect()))


def counted(df):
    """``df`` and the number of its rows that have been computed so far, for whichever columns."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("long")
    def count(value):
        seen.add(1)
        return value

    return df.withColumn("row", count.asNondeterministic()("row")), seen


def test_replacing_computes_its_rows_once(spark, tmp_path, few_zones):
    path = str(tmp_path / "masks")
    rasters.write_raster(spark.createDataFrame(raster("a", 5, 9) + raster("b", 5, 9), MASKS), path, "mask")
    new, seen = counted(spark.createDataFrame(raster("b", 4, 9, mask=1) + raster("c", 4, 9, mask=1), MASKS))
    rasters.write_raster(new, path, "mask")
    assert seen.value == 72
    assert contents(rasters.read_raster(spark, path)) == sorted(raster("a", 5, 9) + raster("b", 4, 9, 1) + raster("c", 4, 9, 1), key=str)


def test_sink_queries_compute_a_raster_once(spark, few_zones):
    cells = [(job, "a", DAY, DAY, r, c, r % 2) for job in range(12) for r in range(3) for c in range(4)]
    made = spark.createDataFrame(cells, "job_id long, aoi_id string, date1 date, date2 date, row long, col long, mask int")
    jobs = spark.range(12).select(F.col("id").alias("job_id"), (F.col("id") + 100).alias("first_request"))
    once, seen = counted(made)
    back = queries._through_sink(spark, SimpleNamespace(jobs=jobs), once, "mask")
    assert sorted(tuple(r) for r in back.collect()) == [(j + 100, a, str(d), str(e), r, c, m) for j, a, d, e, r, c, m in cells]
    assert seen.value == len(cells)
