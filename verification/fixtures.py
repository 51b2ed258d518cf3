"""Test inputs that Spark derives from the driver's tables (see FIXTURES.md).

Sites are dense rasters cut from ``events``; requests come from ``customer``; the scene catalogue comes
from ``orders``. ``oracle.py`` derives the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.functions.numbers import int_div
from terradelta.operators.bands import rgb_of
from terradelta.sources.aoi_library import aoi_library

DATE1, DATE2 = "2024-02-28", "2026-04-03"
SITE_ROWS, SITE_COLS = 25, 100
QUAD = [(4, 1), (96, 2), (90, 24), (10, 23)]
BANDS = ("b02", "b03", "b04", "b08")

# digital numbers of the four bands per patch kind (see FIXTURES.md F3)
BEFORE = (500, 600, 550, 2400)
AFTER = {
    "construction": (1200, 1300, 1250, 5400),
    "vegetation_water": (900, 600, 1150, 900),
    "water": (1000, 1500, 600, 2400),
    "vegetation": (700, 700, 1400, 2400),
    "salt": (1400, 1500, 1450, 2400),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide paired pixels: aoi_id, row, col, b02_1 .. b08_2."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    r, col = int_div(F.col("event_id"), 100), F.col("event_id") % 100
    k = (
        F.when(r < 5, -1)
        .when(F.col("user_id") % 29 == 0, 9)
        .otherwise((int_div(r, 10) + int_div(col, 10) * 3) % 7)
    )
    e = e.withColumns(
        {
            "r": r,
            "col": col,
            "k": k,
            "nz": F.floor(F.col("value") * 100) % 120,
            "salt": F.col("user_id") % 11 == 0,
        }
    )
    values = {}
    for i, band in enumerate(BANDS):
        after = (
            F.when(F.col("k") == 0, AFTER["construction"][i])
            .when(F.col("k") == 1, AFTER["vegetation_water"][i])
            .when(F.col("k") == 2, AFTER["water"][i])
            .when(F.col("k") == 3, AFTER["vegetation"][i])
            .when(F.col("salt"), AFTER["salt"][i])
            .otherwise(BEFORE[i])
        )
        blank = F.col("k") == -1
        values[f"{band}_1"] = F.when(blank, 0).otherwise(F.col("nz") + BEFORE[i]).cast("int")
        values[f"{band}_2"] = F.when(blank, 0).otherwise(F.col("nz") + after).cast("int")
    return e.select(
        F.concat(F.lit("site"), int_div(F.col("r"), SITE_ROWS)).alias("aoi_id"),
        (F.col("r") % SITE_ROWS).alias("row"),
        "col",
        *[v.alias(n) for n, v in values.items()],
    )


def bands(spark: SparkSession, sf_dir: str, extra: bool = True) -> DataFrame:
    """Long pixels: aoi_id, scene_date, band, row, col, dn. ``extra`` adds a band nobody reads."""
    cells = [
        F.struct(
            F.lit(day).cast("date").alias("scene_date"),
            F.lit(band.upper()).alias("band"),
            F.col(f"{band}_{i}").alias("dn"),
        )
        for i, day in ((1, DATE1), (2, DATE2))
        for band in BANDS
    ]
    if extra:
        cells.append(
            F.struct(
                F.lit(DATE1).cast("date").alias("scene_date"),
                F.lit("B11").alias("band"),
                F.lit(100).alias("dn"),
            )
        )
    px = pixels(spark, sf_dir)
    return px.select("aoi_id", "row", "col", F.inline(F.array(*cells))).select(
        "aoi_id", "scene_date", "band", "row", "col", "dn"
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide pixels per date: aoi_id, scene_date, row, col, b02 .. b08."""
    rows = [
        F.struct(
            F.lit(day).cast("date").alias("scene_date"), *[F.col(f"{b}_{i}").alias(b) for b in BANDS]
        )
        for i, day in ((1, DATE1), (2, DATE2))
    ]
    return pixels(spark, sf_dir).select("aoi_id", "row", "col", F.inline(F.array(*rows)))


def _site_number() -> Column:
    return F.expr("cast(substring(aoi_id, 5) as bigint)")


def raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(int_div(F.col("event_id"), SITE_COLS).alias("r"))
    sites = e.groupBy(int_div(F.col("r"), SITE_ROWS).alias("n")).agg(
        (F.max(F.col("r") % SITE_ROWS) + 1).alias("height")
    )
    return sites.select(
        F.concat(F.lit("site"), "n").alias("aoi_id"),
        F.lit(32643).alias("epsg"),
        F.lit(379290.0).alias("x0"),
        (F.lit(2050820) - F.col("n") * 250).cast("double").alias("y0"),
        F.lit(10.0).alias("px"),
        F.lit(10.0).alias("py"),
        F.lit(SITE_COLS).cast("long").alias("width"),
        "height",
    )


def lonlat_ring(site: Column, corners: list[tuple[Column | int, Column | int]]) -> Column:
    """Closed lon/lat ring near a site's raster, from (col, row) corners."""

    def lit(v: Column | int) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    points = [
        F.array(
            (lit(c) * 95 + 73856313) / 1e6,
            (F.lit(18544483) - site * 2259 - lit(r) * 90) / 1e6,
        )
        for c, r in corners
    ]
    return F.array(*points, points[0])


def aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in library plus one area per site."""
    site = _site_number()
    derived = raster_meta(spark, sf_dir).select(
        "aoi_id",
        lonlat_ring(site, QUAD).alias("coords"),
        F.struct(F.lit(DATE1).alias("date1"), F.lit(DATE2).alias("date2")).alias("default_dates"),
    )
    return aoi_library(spark).unionByName(derived)


def planar_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the quadrilateral of each site in raster CRS metres, with the raster frame."""
    meta = raster_meta(spark, sf_dir)
    points = [
        F.struct((F.col("x0") + 10 * c).alias("x"), (F.col("y0") - 10 * r).alias("y"))
        for c, r in [*QUAD, QUAD[0]]
    ]
    return meta.withColumn("planar_ring", F.array(*points))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    variant, site = c % 3, c % 40
    own = lonlat_ring(
        site,
        [
            (variant * 5 + 10, 3),
            (F.lit(80) - variant * 3, variant + 2),
            (85, 20),
            (12, F.lit(22) - variant),
        ],
    )
    return table(spark, sf_dir, "customer").select(
        c.alias("request_id"),
        F.when(c % 13 == 0, F.concat(F.lit("nowhere"), c % 5))
        .when(c % 17 == 1, F.lit("hinjewadi"))
        .otherwise(F.concat(F.lit("site"), site))
        .alias("aoi_id"),
        F.when(c % 3 != 0, F.lit(DATE1)).alias("date1"),
        F.when(c % 11 == 0, F.lit(DATE1)).when(c % 5 != 0, F.lit(DATE2)).alias("date2"),
        F.when(c % 4 == 1, own).alias("coords"),
    )


def gappy_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bands`` without B08 of the second date on odd sites and without seven rows of it on site2, site6, ..."""
    site, late = _site_number(), F.col("scene_date") == F.lit(DATE2).cast("date")
    lost_band = late & (site % 2 == 1) & (F.col("band") == "B08")
    lost_rows = late & (site % 4 == 2) & (F.col("row") < 7)
    return bands(spark, sf_dir).where(~lost_band & ~lost_rows)


def broken_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with unknown areas, polygons of two points or none, open polygons and impossible dates."""
    c = F.col("c_custkey")
    line = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((1.0, 2.0), (3.0, 2.0), (1.0, 2.0))))
    open_ring = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((1.0, 2.0), (3.0, 2.0), (3.0, 4.0))))
    return table(spark, sf_dir, "customer").select(
        c.alias("request_id"),
        F.when(c % 3 == 0, F.lit("nowhere")).otherwise(F.lit("hinjewadi")).alias("aoi_id"),
        F.when(c % 5 == 0, F.lit("2024-13-45")).otherwise(F.lit(DATE1)).alias("date1"),
        F.lit(DATE2).alias("date2"),
        F.when(c % 4 == 1, line).when(c % 4 == 2, open_ring).alias("coords"),
    )


def square(x: Column, y: Column, side: float) -> Column:
    x2, y2 = x + side, y + side
    return F.array(F.array(x, y), F.array(x2, y), F.array(x2, y2), F.array(x, y2), F.array(x, y))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon0 = (F.col("o_custkey") % 10).cast("double")
    lat0 = (int_div(F.col("o_custkey"), 10) % 10).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("product_id"),
        F.col("o_orderdate").alias("sensing_start"),
        F.when(F.col("o_orderstatus") == "F", "S2MSI2A").otherwise("S2MSI1C").alias("product_type"),
        ((F.floor("o_totalprice") % 10001) / 100.0).alias("cloud_cover"),
        square(lon0, lat0, 1.0).alias("footprint"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("product_id"),
        F.concat(F.lit("MSI/L2A/"), day, F.lit("/"), key, F.lit(".SAFE/")).alias("scene"),
        F.concat(F.lit("GRANULE/L2A_"), key, F.lit("/IMG_DATA/R10m/")).alias("granule"),
        F.concat(F.lit("T43QCA_"), day).alias("prefix"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradelta.sources.catalog import asset_paths

    done = scenes(spark, sf_dir).where(F.col("product_id") % 3 == 0)
    return asset_paths(done).select("asset_key")


def scene_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("aoi_id"),
        F.date_add(F.lit("1996-01-01").cast("date"), (c % 700).cast("int")).alias("target_date"),
        square(F.col("c_nationkey") % 10 + F.lit(0.4), c % 10 + F.lit(0.4), 0.2).alias("coords"),
    )


def image(spark: SparkSession, sf_dir: str, date: int) -> DataFrame:
    """display colours of one date."""
    colours = [c.alias(n) for c, n in zip(rgb_of(date), ("red", "green", "blue"))]
    return pixels(spark, sf_dir).select("aoi_id", "row", "col", *colours)


def small_image2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date 2 at half the size: even rows and columns, renumbered."""
    even = (F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)
    half = {c: int_div(F.col(c), 2) for c in ("row", "col")}
    return image(spark, sf_dir, 2).where(even).withColumns(half)


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_meta(spark, sf_dir).select(
        "aoi_id",
        int_div(F.col("width") + 1, 2).alias("src_width"),
        int_div(F.col("height") + 1, 2).alias("src_height"),
        F.col("width").alias("dst_width"),
        F.col("height").alias("dst_height"),
    )


def bench_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each pixel repeated 4 x 4."""
    px = pixels(spark, sf_dir)
    steps = F.sequence(F.lit(0), F.lit(3))
    return (
        px.withColumn("i", F.explode(steps))
        .withColumn("j", F.explode(steps))
        .withColumns({"row": F.col("row") * 4 + F.col("i"), "col": F.col("col") * 4 + F.col("j")})
        .drop("i", "j")
    )


def shared_id_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which four share an id, and some have none: the library's polygon or their own."""
    c = F.col("c_custkey")
    site, v = c % 4, c % 3
    own = lonlat_ring(site, [(v * 7 + 8, 2), (F.lit(88) - v * 4, v + 3), (84, 21), (14, 22)])
    return table(spark, sf_dir, "customer").where(c <= 60).select(
        F.when(c % 15 != 7, int_div(c, 4)).alias("request_id"),
        F.concat(F.lit("site"), site).alias("aoi_id"),
        F.lit(DATE1).alias("date1"),
        F.lit(DATE2).alias("date2"),
        F.when(c % 2 == 1, own).alias("coords"),
    )


# --- scenes of a catalogue: rasters named by product, some over two sites (see FIXTURES.md) -----------


def scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two products a site (numbers 4n, 4n + 1: date 1, 2), and two from row 12 on, over the next site (4n + 2, 4n + 3)."""
    line = int_div(F.col("event_id"), SITE_COLS)
    first = F.when(F.col("kind") > 1, 12).otherwise(0)
    kinds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("kind")
    lines = table(spark, sf_dir, "events").select(line.alias("line"), kinds).withColumn("first", first).where("line >= first")
    products = lines.groupBy(int_div(F.col("line") - F.col("first"), SITE_ROWS).alias("n"), "kind", "first").agg(
        (F.max((F.col("line") - F.col("first")) % SITE_ROWS) + 1).alias("height")
    )
    top = F.col("n") * SITE_ROWS + F.col("first")
    return products.select(
        (F.col("n") * 4 + F.col("kind")).alias("raster_id"),
        F.lit(32643).alias("epsg"),
        F.lit(379290.0).alias("x0"),
        (F.lit(2050820) - top * 10).cast("double").alias("y0"),
        F.lit(10.0).alias("px"),
        F.lit(10.0).alias("py"),
        F.lit(SITE_COLS).cast("long").alias("width"),
        "height",
    )


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide pixels of the products: raster_id, row, col, b02 .. b08. Products over two sites are a little bluer."""
    line = _site_number() * SITE_ROWS + F.col("row")
    cells = []
    for slot in (0, 1):
        values = [F.col(f"{b}_{slot + 1}") for b in BANDS]
        for offset, kind, bluer in ((0, slot, 0), (12, slot + 2, 7)):
            at = line - offset
            named = [(v + bluer if b == "b02" else v).alias(b) for v, b in zip(values, BANDS)]
            cell = F.struct((int_div(at, SITE_ROWS) * 4 + kind).alias("raster_id"), (at % SITE_ROWS).alias("row"), *named)
            cells.append(cell if not offset else F.when(at >= 0, cell))
    px = pixels(spark, sf_dir).select("col", F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    return px.select("cell.raster_id", "cell.row", "col", *[f"cell.{b}" for b in BANDS])


def scene_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products with a day near their date, a cloud cover and a footprint; one in five is of another type."""
    i = F.col("raster_id")
    kind = i % 4
    day = F.when(kind % 2 == 0, F.lit(DATE1)).otherwise(F.lit(DATE2)).cast("date")
    top = int_div(i, 4) * 2259 + F.when(kind > 1, 12 * 90).otherwise(0)
    high, low = (F.lit(18544533) - top) / 1e6, (F.lit(18542183) - top) / 1e6
    corners = [(73.8, low), (73.9, low), (73.9, high), (73.8, high), (73.8, low)]
    return scene_frames(spark, sf_dir).select(
        i.alias("product_id"),
        (F.date_add(day, ((i * 5) % 7 - 3).cast("int")).cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(raster_id % 24 as int))")).alias("sensing_start"),
        F.when(i % 5 == 4, "S2MSI1C").otherwise("S2MSI2A").alias("product_type"),
        ((i * 37 % 101).cast("double") + 0.25).alias("cloud_cover"),
        F.array(*(F.array(F.lit(x), y) for x, y in corners)).alias("footprint"),
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons under names of their own, each over two sites."""
    c = F.col("c_custkey") % 20
    v = c % 5
    ring = lonlat_ring(c % 4, [(v * 5 + 10, 15), (F.lit(80) - v * 3, v + 17), (85, 33), (12, F.lit(36) - v)])
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("plot"), c).alias("aoi_id"), ring.alias("coords")).distinct()


def plot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for plots, days off the scenes, and too many for some."""
    c = F.col("c_custkey")
    rings_of = plots(spark, sf_dir)
    day1 = F.date_add(F.lit(DATE1).cast("date"), (c % 3 * 5 - 6).cast("int"))
    day2 = F.date_add(F.lit(DATE2).cast("date"), (c % 2 * 3 - 1).cast("int"))
    asked = table(spark, sf_dir, "customer").select(
        c.alias("request_id"), F.concat(F.lit("plot"), c % 20).alias("aoi_id"), day1.cast("string").alias("date1"), day2.cast("string").alias("date2")
    )
    return asked.join(rings_of, "aoi_id").select("request_id", "aoi_id", "date1", "date2", "coords")
