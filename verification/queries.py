"""Queries registered with the driver, one per operator, each over whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.functions import projection, rings, spectral
from terradelta.functions.utm import from_utm, to_utm
from terradelta.operators import (
    bands,
    bitrows,
    layers,
    metrics,
    morphology,
    mosaic,
    regions,
    requests,
    sampling,
    scenes,
)
from terradelta.operators.resize import resize_bilinear
from terradelta.plans.detect import detect_changes
from terradelta.plans import incremental
from terradelta.plans.from_catalog import detect_from_catalog
from terradelta.plans.legacy import comparison_strip, detect_changes_legacy, legacy_words
from terradelta.plans.scene_plan import plan_scenes
from terradelta.sources import aoi_library, catalog, naming, rasters, sinks
from verification import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ["aoi_id"]
CLASSES = ("new_construction", "vegetation_loss", "surface_water")
BASE_URI = "http://localhost:8000"
OUTPUTS = f"{BASE_URI}/outputs"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(ring: Column) -> Column:
    """A ring as text with six decimals, the same in every engine."""
    micro = F.transform(ring, lambda p: F.concat_ws(" ", _micro(p[0]), _micro(p[1])))
    return F.array_join(micro, ",")


def _micro(value: Column) -> Column:
    return F.round(value * 1e6).cast("long").cast("string")


def _round(value: Column, digits: int) -> Column:
    return F.round(value, digits) + F.lit(0.0)


# --- scans, sources, sinks -------------------------------------------------------------------------


@query
def aoi_list(spark, sf):
    listed = aoi_library.list_aois(fx.aois(spark, sf))
    return listed.select(
        "id",
        "name",
        _text(F.col("coordinates")).alias("coordinates"),
        F.col("default_dates.date1").alias("date1"),
        F.col("default_dates.date2").alias("date2"),
    )


@query
def band_scan(spark, sf):
    px = rasters.only_bands(fx.bands(spark, sf))
    return px.withColumn("scene_date", F.col("scene_date").cast("string"))


@query
def catalog_scan(spark, sf):
    return catalog.of_type(fx.catalog(spark, sf)).select(
        "product_id",
        F.date_format("sensing_start", "yyyy-MM-dd").alias("sensing_day"),
        "product_type",
        "cloud_cover",
        _text(F.col("footprint")).alias("footprint"),
    )


@query
def asset_paths(spark, sf):
    return catalog.asset_paths(fx.scenes(spark, sf)).select("product_id", "asset_band", "asset_key")


@query
def pending_assets(spark, sf):
    assets = catalog.asset_paths(fx.scenes(spark, sf)).select("product_id", "asset_key")
    return catalog.pending(assets, fx.manifest(spark, sf))


def _scratch(spark) -> str:
    """A new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/written-{uuid.uuid4().hex}"


@query
def raster_roundtrip(spark, sf):
    folder = _scratch(spark)
    rasters.write_raster(fx.dated(spark, sf), folder, "bands")
    return rasters.read_raster(spark, folder).select(
        "aoi_id", F.col("scene_date").cast("string").alias("scene_date"), "row", "col", *fx.BANDS
    )


@query
def artifact_names(spark, sf):
    req = requests.default_dates(fx.requests(spark, sf), fx.aois(spark, sf))
    names = naming.artifact_names(F.col("aoi_id"), F.col("date1"), F.col("date2"))
    return req.select("request_id", *[c.alias(n) for n, c in names.items()])


@query
def legacy_artifact_names(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    names = naming.legacy_artifact_names(F.col("o_orderpriority"), day)
    orders = fx.table(spark, sf, "orders")
    return orders.select("o_orderkey", *[c.alias(n) for n, c in names.items()])


@query
def resolve_uri(spark, sf):
    key = F.col("o_orderkey")
    uri = (
        F.when(key % 4 == 0, F.concat(F.lit("/outputs/processed/"), key, F.lit(".png")))
        .when(key % 4 == 1, F.concat(F.lit("http://localhost:8000/outputs/"), key))
        .when(key % 4 == 2, F.concat(F.lit("outputs/"), key))
    )
    orders = fx.table(spark, sf, "orders")
    return orders.select("o_orderkey", naming.resolve_uri(uri, BASE_URI).alias("uri"))


@query
def placeholder_fill(spark, sf):
    filled = rasters.with_placeholder(fx.requests(spark, sf), fx.image(spark, sf, 1), KEYS, fx.raster_meta(spark, sf))
    sums = [F.sum(c).cast("long").alias(f"sum_{c}") for c in ("row", "col", "red", "green", "blue")]
    return filled.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("pixels"), *sums)


# --- projections and scalar maths ------------------------------------------------------------------


def _images(spark, sf, *columns):
    return fx.pixels(spark, sf).select("aoi_id", "row", "col", *columns)


@query
def stack_bands(spark, sf):
    px = rasters.only_bands(fx.bands(spark, sf))
    stacked = bands.stack_bands(px)
    return stacked.withColumn("scene_date", F.col("scene_date").cast("string"))


@query
def unstack_bands(spark, sf):
    long = bands.unstack_bands(fx.dated(spark, sf))
    return long.withColumn("scene_date", F.col("scene_date").cast("string"))


@query
def natural_rgb(spark, sf):
    return fx.dated(spark, sf).select(
        "aoi_id",
        F.col("scene_date").cast("string").alias("scene_date"),
        "row",
        "col",
        *spectral.natural_rgb(F.col("b04"), F.col("b03"), F.col("b02")),
    )


@query
def ndvi(spark, sf):
    px = bands.with_indices(fx.pixels(spark, sf))
    return px.select(
        "aoi_id", "row", "col", *[_round(F.col(c).cast("double"), 6).alias(c) for c in ("ndvi_1", "ndvi_2")]
    )


@query
def ndwi(spark, sf):
    px = bands.with_indices(fx.pixels(spark, sf))
    return px.select(
        "aoi_id", "row", "col", *[_round(F.col(c).cast("double"), 6).alias(c) for c in ("ndwi_1", "ndwi_2")]
    )


@query
def rgb_difference(spark, sf):
    value = spectral.rgb_difference(bands.rgb_of(1), bands.rgb_of(2))
    return _images(spark, sf, _round(value, 6).alias("difference"))


@query
def change_mask(spark, sf):
    value = spectral.rgb_difference(bands.rgb_of(1), bands.rgb_of(2))
    return _images(spark, sf, spectral.threshold(value, spectral.RGB_THRESHOLD).alias("mask"))


@query
def grayscale(spark, sf):
    return _images(
        spark, sf, *[spectral.grayscale(*bands.rgb_of(i)).alias(f"gray{i}") for i in (1, 2)]
    )


def _gray_difference():
    return spectral.absolute_difference(
        spectral.grayscale(*bands.rgb_of(1)), spectral.grayscale(*bands.rgb_of(2))
    )


@query
def gray_absdiff(spark, sf):
    return _images(spark, sf, _gray_difference().alias("difference"))


@query
def gray_change_mask(spark, sf):
    mask = spectral.threshold(_gray_difference(), spectral.GRAY_THRESHOLD)
    return _images(spark, sf, mask.alias("mask"))


def _deltas(spark, sf):
    px = bands.with_indices(fx.pixels(spark, sf))
    deltas = spectral.index_deltas(*[F.col(c) for c in ("ndvi_1", "ndvi_2", "ndwi_1", "ndwi_2")])
    return px.select("*", *deltas)


@query
def index_deltas(spark, sf):
    return _deltas(spark, sf).select(
        "aoi_id",
        "row",
        "col",
        *[_round(F.col(c).cast("double"), 6).alias(c) for c in ("ndvi_drop", "ndwi_rise")],
    )


@query
def classify_pixels(spark, sf):
    px = _deltas(spark, sf)
    flags = spectral.class_flags(
        spectral.rgb_changed(bands.rgb_of(1), bands.rgb_of(2)),
        spectral.lost_vegetation(F.col("ndvi_drop")),
        spectral.moved_water(F.col("ndwi_rise")),
    )
    flagged = px.select("aoi_id", "row", "col", *flags)
    return flagged.select("aoi_id", "row", "col", *[F.col(c).cast("int").alias(c) for c in CLASSES])


@query
def change_overlay(spark, sf):
    return layers.change_overlay(fx.pixels(spark, sf), KEYS)


# --- geometry --------------------------------------------------------------------------------------


@query
def aoi_latlon(spark, sf):
    nested = fx.aois(spark, sf).withColumn("coords", F.array("coords"))
    flat = rings.normalize_ring(nested, "coords")
    return flat.select("aoi_id", _text(rings.swap_axes(F.col("coords"))).alias("latlon"))


@query
def ring_wkt(spark, sf):
    return fx.aois(spark, sf).select("aoi_id", rings.ring_to_wkt(F.col("coords")).alias("wkt"))


@query
def to_utm_points(spark, sf):
    px = fx.pixels(spark, sf).select("aoi_id", "row", "col")
    placed = px.withColumns(
        {
            "lon": (F.col("col") * 95 + 73856313) / 1e6,
            "lat": (F.lit(18544483) - F.col("row") * 90) / 1e6,
        }
    )
    x, y = to_utm(F.col("lon"), F.col("lat"), F.lit(32643))
    return placed.select("aoi_id", "row", "col", _round(x, 3).alias("x"), _round(y, 3).alias("y"))


@query
def from_utm_points(spark, sf):
    px = fx.pixels(spark, sf).select("aoi_id", "row", "col")
    placed = regions.pixel_xy(px, fx.raster_meta(spark, sf))
    lon, lat = from_utm(F.col("x"), F.col("y"), F.lit(32643))
    return placed.select(
        "aoi_id", "row", "col", _round(lon, 6).alias("lon"), _round(lat, 6).alias("lat")
    )


@query
def pixel_xy(spark, sf):
    px = fx.pixels(spark, sf).select("aoi_id", "row", "col")
    return regions.pixel_xy(px, fx.raster_meta(spark, sf))


def _site_windows(spark, sf):
    placed = regions.place_planar_rings(fx.planar_regions(spark, sf))
    return regions.touching(regions.crop_window(placed))


@query
def crop_window(spark, sf):
    columns = ["col_min", "col_max", "row_min", "row_max", "crop_width", "crop_height"]
    return _site_windows(spark, sf).select("aoi_id", *columns, "crop_x0", "crop_y0")


@query
def clip_to_aoi(spark, sf):
    halo = 4
    masks = regions.burn(_site_windows(spark, sf), KEYS, halo)
    px = bitrows.with_address(fx.dated(spark, sf), halo)
    clipped = regions.clip(px, masks, KEYS, halo, fx.BANDS)
    return clipped.select(
        "aoi_id",
        F.col("scene_date").cast("string").alias("scene_date"),
        "row",
        "col",
        "inside",
        *[F.col(b).cast("int").alias(b) for b in fx.BANDS],
    )


@query
def bounds_center(spark, sf):
    box = regions.bounds_center(fx.raster_meta(spark, sf))
    return box.select("aoi_id", *[_round(F.col(c), 6).alias(c) for c in box.columns[1:]])


@query
def footprint_intersects(spark, sf):
    """Square around each customer against a diamond around each of their orders."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    x, y = F.col("c_nationkey") % 10 + F.lit(0.25), c % 10 + F.lit(0.25)
    cx = o % 10 + F.lit(0.0625)
    cy = fx.int_div(o, 10) % 10 + F.lit(0.28125)
    diamond = F.array(
        F.array(cx - 1.5, cy), F.array(cx, cy - 1.5), F.array(cx + 1.5, cy), F.array(cx, cy + 1.5),
        F.array(cx - 1.5, cy),
    )
    area, footprint = rings.planar(fx.square(x, y, 2.0)), rings.planar(diamond)
    customers = rings.with_shape(fx.table(spark, sf, "customer"), area, "a_")
    orders = rings.with_shape(fx.table(spark, sf, "orders"), footprint, "b_")
    pairs = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return pairs.select("o_orderkey", rings.shapes_meet("a_", "b_").cast("int").alias("hit"))


# --- joins -----------------------------------------------------------------------------------------


@query
def pair_dates(spark, sf):
    pairs = fx.raster_meta(spark, sf).select(
        "aoi_id",
        F.explode(F.array(*[F.lit(d).cast("date") for d in (fx.DATE1, fx.DATE2)])).alias("date1"),
        F.lit(fx.DATE2).cast("date").alias("date2"),
    )
    px = bands.pair_dates(fx.dated(spark, sf), pairs)
    return px.withColumns({d: F.col(d).cast("string") for d in ("date1", "date2")})


@query
def top_scenes(spark, sf):
    found = scenes.top_scenes(fx.scene_requests(spark, sf), fx.catalog(spark, sf))
    return found.select("aoi_id", "product_id", "cloud_cover", F.col("rank").cast("int").alias("rank"))


@query
def select_scene(spark, sf):
    found = scenes.select_scenes(fx.scene_requests(spark, sf), fx.catalog(spark, sf))
    return found.select(
        "aoi_id",
        "product_id",
        "cloud_cover",
        F.date_format("sensing_start", "yyyy-MM-dd").alias("sensing_day"),
    )


@query
def resolve_aoi(spark, sf):
    resolved = requests.resolve_aoi(fx.requests(spark, sf), fx.aois(spark, sf))
    return resolved.select("request_id", "aoi_id", _text(F.col("coords")).alias("coords"))


@query
def rejected_requests(spark, sf):
    return requests.rejected_requests(fx.requests(spark, sf), fx.aois(spark, sf))


@query
def rejected_bad_input(spark, sf):
    return requests.rejected_requests(fx.broken_requests(spark, sf), fx.aois(spark, sf))


@query
def default_dates(spark, sf):
    filled = requests.default_dates(fx.requests(spark, sf), fx.aois(spark, sf))
    return filled.select("request_id", "date1", "date2")


@query
def default_dates_array(spark, sf):
    """As default_dates, with the library's dates given as two-element arrays."""
    aois = fx.aois(spark, sf).withColumn(
        "default_dates", F.array("default_dates.date2", "default_dates.date1")
    )
    filled = requests.default_dates(fx.requests(spark, sf), aois)
    return filled.select("request_id", "date1", "date2")


# --- neighbourhoods --------------------------------------------------------------------------------


def _mask(spark, sf):
    changed = spectral.rgb_changed(bands.rgb_of(1), bands.rgb_of(2))
    return _images(spark, sf, changed.cast("int").alias("mask"))


@query
def erode(spark, sf):
    return morphology.erode(_mask(spark, sf), "mask", 3)


@query
def dilate(spark, sf):
    return morphology.dilate(_mask(spark, sf), "mask", 3)


@query
def morph_open(spark, sf):
    return morphology.morph_open(_mask(spark, sf), "mask", 3)


@query
def morph_open_5(spark, sf):
    return morphology.morph_open(_mask(spark, sf), "mask", 5)


@query
def morph_close(spark, sf):
    return morphology.morph_close(_mask(spark, sf), "mask", 3)


@query
def morph_clean(spark, sf):
    return morphology.morph_clean(_mask(spark, sf), "mask", 3)


@query
def resize(spark, sf):
    resized = resize_bilinear(fx.small_image2(spark, sf), fx.image_sizes(spark, sf), ("red", "green", "blue"))
    return resized


@query
def side_by_side(spark, sf):
    strip = comparison_strip(
        fx.image(spark, sf, 1), fx.small_image2(spark, sf), fx.image_sizes(spark, sf)
    )
    return strip


# --- aggregates ------------------------------------------------------------------------------------


def _clean_words(spark, sf):
    steps = morphology.cleaning(3)
    halo = morphology.halo_of(steps)
    words = bitrows.pack(fx.pixels(spark, sf), KEYS, bands.change_flags(), halo)
    words = morphology.transform_words(words, KEYS, ["mask"], steps, ["vegetation", "water"])
    return words, halo


@query
def change_counts(spark, sf):
    counts = metrics.count_words(_clean_words(spark, sf)[0], KEYS)
    return counts.select("aoi_id", "total_pixels", "changed_pixels")


@query
def raw_change_counts(spark, sf):
    return metrics.count_mask(_mask(spark, sf), "mask", KEYS)


@query
def change_metrics(spark, sf):
    counts = metrics.with_change(metrics.count_words(_clean_words(spark, sf)[0], KEYS))
    return counts.select("aoi_id", "changed_pixels", "change_percentage", "changed_area_km2")


@query
def class_areas(spark, sf):
    areas = metrics.with_class_areas(metrics.count_words(_clean_words(spark, sf)[0], KEYS))
    return areas.drop("total_pixels", "changed_pixels")


@query
def legacy_metrics(spark, sf):
    from terradelta.plans.legacy import legacy_metrics as summarize

    words, _ = legacy_words(fx.image(spark, sf, 1), fx.image(spark, sf, 2))
    return summarize(words)


@query
def legacy_document(spark, sf):
    from terradelta.plans.legacy import legacy_document as document

    counted = detect_changes_legacy(fx.image(spark, sf, 1), fx.small_image2(spark, sf), fx.image_sizes(spark, sf))
    made = document(counted, F.lit(fx.DATE2))
    return made.select(*[c for c in made.columns if c != "filenames"], "filenames.*")


@query
def raster_extent(spark, sf):
    return regions.raster_extent(fx.pixels(spark, sf))


# --- ranks and samples -----------------------------------------------------------------------------


def _ranked(spark, sf):
    words, halo = _clean_words(spark, sf)
    long = sampling.class_long(words, KEYS, metrics.class_words())
    keys = [*KEYS, "class"]
    return sampling.rank_words(long, keys), keys, halo


@query
def mask_rank(spark, sf):
    return sampling.rank_pixels(*_ranked(spark, sf))


@query
def even_sample(spark, sf):
    return sampling.even_sample(*_ranked(spark, sf), 200).drop("n")


@query
def even_sample_7(spark, sf):
    return sampling.even_sample(*_ranked(spark, sf), 7).drop("n")


def _points(spark, sf):
    sampled = sampling.even_sample(*_ranked(spark, sf), 200)
    shown = sampled.where(F.col("class").isin("new_construction", "surface_water"))
    return layers.lonlat_points(shown, fx.raster_meta(spark, sf))


@query
def mask_points(spark, sf):
    return _points(spark, sf).select(
        "aoi_id", "class", "rank", _round(F.col("lat"), 6).alias("lat"), _round(F.col("lon"), 6).alias("lon")
    )


# --- dates, documents, layers ----------------------------------------------------------------------


@query
def date_window(spark, sf):
    orders = fx.table(spark, sf, "orders")
    window = requests.date_window(F.date_format("o_orderdate", "yyyy-MM-dd"))
    spans = orders.select("o_orderkey", *window)
    return spans.withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end")})


@query
def feature_layers(spark, sf):
    sites = fx.aois(spark, sf).select("aoi_id", "coords")
    return _read_features(layers.feature_layers(sites, _points(spark, sf), KEYS), KEYS)


def _read_features(features, keys):
    """The text of GeoJSON features as columns, coordinates in millionths of a degree."""
    parsed = F.from_json(
        "feature",
        "type string, geometry struct<type string, coordinates string>, properties struct<"
        "tooltip string, popup string, color string, weight int, radius int, fill_opacity double>",
    )
    read = features.select(*keys, "layer", parsed.alias("f"))
    numbers = F.regexp_extract_all("f.geometry.coordinates", F.lit(r"(-?\d[0-9.eE+-]*)"), 1)
    return read.select(
        *keys,
        "layer",
        F.col("f.geometry.type").alias("geometry"),
        F.array_join(F.transform(numbers, lambda n: _micro(n.cast("double"))), " ").alias("micro"),
        F.coalesce("f.properties.tooltip", "f.properties.popup").alias("label"),
        F.col("f.properties.color").alias("color"),
        F.coalesce("f.properties.weight", "f.properties.radius").alias("size"),
        F.col("f.properties.fill_opacity").alias("fill_opacity"),
    )


def _detection(spark, sf):
    return detect_changes(
        fx.requests(spark, sf), fx.bands(spark, sf), fx.aois(spark, sf), fx.raster_meta(spark, sf)
    )


def _by_request(detection, df):
    """Jobs named by the smallest id among the requests that share them."""
    names = detection.jobs.select("job_id", "first_request")
    named = df.join(names, "job_id").withColumn("job_id", F.col("first_request")).drop("first_request")
    return named


def _plain_dates(df):
    return df.withColumns({d: F.col(d).cast("string") for d in ("date1", "date2")})


@query
def detect(spark, sf):
    return _plain_dates(_detection(spark, sf).metrics())


@query
def detect_changes_wide(spark, sf):
    """As detect_changes, from pixels stored with one column per band."""
    detection = detect_changes(
        fx.requests(spark, sf), fx.dated(spark, sf), fx.aois(spark, sf), fx.raster_meta(spark, sf)
    )
    return _plain_dates(detection.metrics())


@query
def detect_points(spark, sf):
    found = _detection(spark, sf)
    return _plain_dates(_by_request(found, found.points().drop("n")))


@query
def detect_masks(spark, sf):
    found = _detection(spark, sf)
    return _plain_dates(_by_request(found, found.masks()))


@query
def detect_overlay(spark, sf):
    found = _detection(spark, sf)
    return _plain_dates(_by_request(found, found.overlay()))


@query
def detect_features(spark, sf):
    found = _detection(spark, sf)
    features = _read_features(found.features(), ["job_id", "aoi_id", "date1", "date2"])
    return _plain_dates(_by_request(found, features))


@query
def job_bounds(spark, sf):
    found = _detection(spark, sf)
    box = _plain_dates(found.bounds())
    keys = ["job_id", "aoi_id", "date1", "date2"]
    return _by_request(found, box.select(*keys, *[_round(F.col(c), 6).alias(c) for c in box.columns[4:]]))


@query
def unserved_requests(spark, sf):
    return _detection(spark, sf).unserved()


def _gappy(spark, sf):
    return detect_changes(
        fx.requests(spark, sf), fx.gappy_bands(spark, sf), fx.aois(spark, sf), fx.raster_meta(spark, sf)
    )


@query
def incomplete_rasters(spark, sf):
    """What the rectangles of requests lack, from rasters without a band or without some rows."""
    return _gappy(spark, sf).incomplete()


@query
def detect_complete_only(spark, sf):
    """Requests that rasters with gaps can still answer."""
    return _plain_dates(_gappy(spark, sf).metrics())


def _through_sink(spark, found, raster, kind, dates=("date1", "date2")):
    """A job's rasters written and read back; a second write of one job must leave the others in place."""
    folder, keys = _scratch(spark), ("job_id", "aoi_id")
    raster.write.parquet(made := _scratch(spark))  # two writes need it: detected once
    raster = spark.read.schema(raster.schema).parquet(made)
    rasters.write_raster(raster, folder, kind, keys, dates)
    one = raster.where(F.col("job_id") % 7 == 3)
    rasters.write_raster(one, folder, kind, keys, dates)
    back = rasters.read_raster(spark, folder).withColumns({d: F.col(d).cast("string") for d in dates})
    back = _by_request(found, back.withColumn("job_id", F.col("job_id").cast("long")))
    return back.select("job_id", "aoi_id", *dates, "row", "col", *rasters.KINDS[kind])


@query
def mask_sink(spark, sf):
    return _through_sink(spark, (found := _detection(spark, sf)), found.masks(), "mask")


@query
def overlay_sink(spark, sf):
    return _through_sink(spark, (found := _detection(spark, sf)), found.overlay(), "overlay")


@query
def rgb_sink(spark, sf):
    return _through_sink(spark, (found := _detection(spark, sf)), found.rasters(), "rgb", ("date1", "date2", "scene_date"))


@query
def ndvi_sink(spark, sf):
    back = _through_sink(spark, (found := _detection(spark, sf)), found.rasters(), "ndvi", ("date1", "date2", "scene_date"))
    return back.withColumn("ndvi", _round(F.col("ndvi").cast("double"), 6))


@query
def ndwi_sink(spark, sf):
    back = _through_sink(spark, (found := _detection(spark, sf)), found.rasters(), "ndwi", ("date1", "date2", "scene_date"))
    return back.withColumn("ndwi", _round(F.col("ndwi").cast("double"), 6))


@query
def feature_sink(spark, sf):
    """Features written as text and read back: the text alone tells the request."""
    folder = _scratch(spark)
    found = _detection(spark, sf)
    sinks.write_features(found.features(), folder)
    whose = F.from_json("value", "properties struct<job_id string, aoi_id string, date1 string, date2 string>").properties
    text = spark.read.text(folder).select("layer", F.col("value").alias("feature"), whose.alias("w"))
    keyed = text.select(F.col("w.job_id").cast("long").alias("job_id"), "w.aoi_id", "w.date1", "w.date2", "layer", "feature")
    return _by_request(found, _read_features(keyed, ["job_id", "aoi_id", "date1", "date2"]))


@query
def metrics_document(spark, sf):
    documents = _plain_dates(_detection(spark, sf).documents(OUTPUTS))
    return documents.select(
        *[c for c in documents.columns if c != "classification"], "classification.*"
    )


@query
def result_summary(spark, sf):
    """Requests without a result keep their row, so missing values show as N/A."""
    documents = _detection(spark, sf).documents(OUTPUTS).drop("aoi_id")
    asked = fx.requests(spark, sf).select("request_id", "aoi_id")
    return metrics.result_summary(asked.join(documents, "request_id", "left"))


@query
def detect_legacy(spark, sf):
    return detect_changes_legacy(
        fx.image(spark, sf, 1), fx.small_image2(spark, sf), fx.image_sizes(spark, sf)
    )


def _scene_plan(spark, sf, known="true"):
    return plan_scenes(
        fx.scene_requests(spark, sf),
        fx.catalog(spark, sf),
        fx.scenes(spark, sf).where(known),
        fx.manifest(spark, sf),
    )


@query
def scene_plan(spark, sf):
    return _scene_plan(spark, sf).to_fetch.select("product_id", "asset_key")


@query
def unmatched_scenes(spark, sf):
    unmatched = _scene_plan(spark, sf).unmatched
    return unmatched.select("aoi_id", F.col("target_date").cast("string").alias("target_date"))


@query
def requests_sharing_an_id(spark, sf):
    """Requests that share an id, or have none, each keep their own result."""
    found = detect_changes(
        fx.shared_id_requests(spark, sf), fx.dated(spark, sf), fx.aois(spark, sf), fx.raster_meta(spark, sf)
    )
    return _plain_dates(found.metrics())


def _catalog_detection(spark, sf):
    return detect_from_catalog(
        fx.plot_requests(spark, sf), fx.scene_pixels(spark, sf), fx.aois(spark, sf), fx.scene_catalog(spark, sf), fx.scene_frames(spark, sf),
        path=_scratch(spark),
    )


@query
def detect_catalog(spark, sf):
    """Change between the clearest scenes near two dates, for polygons over two rasters."""
    return _plain_dates(_catalog_detection(spark, sf).metrics())


@query
def unserved_catalog(spark, sf):
    """Dates without a scene, by name, and rectangles that the scenes do not fill."""
    return _catalog_detection(spark, sf).unserved()


@query
def catalog_sources(spark, sf):
    """The products that each request is answered from."""
    used = _catalog_detection(spark, sf).scenes()
    return used.withColumns({c: F.col(c).cast("int") for c in ("date", "rank")})


@query
def clip_mosaic(spark, sf):
    """Plots cut out of all rasters of the first date; where they overlap, the higher product number wins."""
    first = F.col("raster_id") % 2 == 0
    frames = fx.scene_frames(spark, sf).where(first).withColumn("turn", -F.col("raster_id"))
    got = mosaic.clip_mosaic(fx.plots(spark, sf), fx.scene_pixels(spark, sf).where(first), frames, "aoi_id", fx.BANDS, ["turn"], path=_scratch(spark))
    return got.withColumn("rank", F.col("rank").cast("int"))


@query
def footprint_intersects_seam(spark, sf):
    """As footprint_intersects, with all longitudes turned so that the shapes lie across the 180th meridian."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    x, y = F.col("c_nationkey") % 10 + F.lit(0.25), c % 10 + F.lit(0.25)
    cx = o % 10 + F.lit(0.0625)
    cy = fx.int_div(o, 10) % 10 + F.lit(0.28125)

    def across(lon):
        return F.pmod(lon + 355.0, F.lit(360.0)) - 180.0

    box = [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0), (x, y)]
    diamond = [(cx - 1.5, cy), (cx, cy - 1.5), (cx + 1.5, cy), (cx, cy + 1.5), (cx - 1.5, cy)]
    area, footprint = (rings.planar(rings.unwrapped(F.array(*(F.array(across(a), b) for a, b in ring)))) for ring in (box, diamond))
    customers = rings.with_shape(fx.table(spark, sf, "customer"), area, "a_")
    orders = rings.with_shape(fx.table(spark, sf, "orders"), footprint, "b_")
    pairs = rings.turned(orders.join(customers, orders.o_custkey == customers.c_custkey), "a_", "b_")
    return pairs.select("o_orderkey", rings.shapes_meet("a_", "b_").cast("int").alias("hit"))


def _coded(spark, sf):
    """Pixels with a place and one of four EPSG codes, the last of no supported kind."""
    px = fx.pixels(spark, sf).select("aoi_id", "row", "col")
    kind = (F.col("row") + F.col("col")) % 4
    return px.withColumns(
        {
            "epsg": F.when(kind == 0, 32643).when(kind == 1, 4326).when(kind == 2, 3857).otherwise(2154),
            "lon": (F.col("col") * 95 + 73856313) / 1e6,
            "lat": (F.lit(18544483) - F.col("row") * 90) / 1e6,
        }
    )


@query
def to_crs(spark, sf):
    x, y = projection.to_crs(F.col("lon"), F.col("lat"), F.col("epsg"))
    return _coded(spark, sf).select("aoi_id", "row", "col", "epsg", _round(x, 3).alias("x"), _round(y, 3).alias("y"))


@query
def from_crs(spark, sf):
    """Places in each CRS, made from rows and columns, as longitude and latitude."""
    x = F.when(F.col("epsg") == 4326, F.col("lon")).when(F.col("epsg") == 3857, F.col("col") * 10 + 8221000.0).otherwise(F.col("col") * 10 + 379295.0)
    y = F.when(F.col("epsg") == 4326, F.col("lat")).when(F.col("epsg") == 3857, F.lit(2100000.0) - F.col("row") * 10).otherwise(F.lit(2050815.0) - F.col("row") * 10)
    lon, lat = projection.from_crs(x, y, F.col("epsg"))
    return _coded(spark, sf).select("aoi_id", "row", "col", "epsg", _round(lon, 6).alias("lon_out"), _round(lat, 6).alias("lat_out"))


@query
def pending_jobs(spark, sf):
    """Jobs that a manifest of every other job leaves to do."""
    asked, areas = fx.requests(spark, sf), fx.aois(spark, sf)
    jobs = requests.distinct_jobs(requests.resolve(asked, areas))
    todo = incremental.pending_jobs(asked, areas, jobs.where("first_request % 2 = 0"))
    return _plain_dates(todo.select("first_request", "aoi_id", "date1", "date2"))


@query
def scene_outcomes(spark, sf):
    """What the scene search found for each request."""
    found = _scene_plan(spark, sf, "product_id % 11 <> 0").outcome
    return found.select("aoi_id", F.col("target_date").cast("string").alias("target_date"), "product_id", "outcome")


@query
def unlocated_scenes(spark, sf):
    """Chosen products without known files."""
    return _scene_plan(spark, sf, "product_id % 11 <> 0").unlocated


@query
def scene_placeholders(spark, sf):
    """Placeholder rasters of requests without a scene, 8 x 8, summed up."""
    made = _scene_plan(spark, sf).placeholders(height=8, width=8)
    sums = [F.sum(c).cast("long").alias(f"sum_{c}") for c in ("row", "col", "red", "green", "blue")]
    return made.groupBy("aoi_id", F.col("target_date").cast("string").alias("target_date")).agg(F.count(F.lit(1)).alias("pixels"), *sums)


# Registered under the names of the inventory where a function name would shadow an import.
for _name, _key in {
    "to_utm_points": "to_utm",
    "from_utm_points": "from_utm",
    "resize": "resize_bilinear",
    "detect": "detect_changes",
    "detect_legacy": "detect_changes_legacy",
    "scene_plan": "plan_scenes",
    "detect_catalog": "detect_from_catalog",
}.items():
    QUERIES[_key] = QUERIES.pop(_name)
