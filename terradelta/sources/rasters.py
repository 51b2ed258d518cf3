"""Pixel tables on storage: band scans, raster sinks and placeholder rasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.functions.numbers import floor_div
from terradelta.operators.bands import BANDS
from terradelta.operators.bitrows import TILE_ROWS
from terradelta.session import fan_out
from terradelta.sources import curve

# Size and colour of the raster that stands in for a failed scene.
PLACEHOLDER_SIZE = 512
PLACEHOLDER_RGB = (15, 32, 67)

# Columns of each raster kind besides the keys, scene_date, row and col.
KINDS = {
    "bands": ("b02", "b03", "b04", "b08"),
    "rgb": ("red", "green", "blue"),
    "ndvi": ("ndvi",),
    "ndwi": ("ndwi",),
    "mask": ("mask",),
    "overlay": ("red", "green", "blue"),
}


def only_bands(px: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Rows of the given bands; pushed to the scan (or prunes partitions by band)."""
    return px.where(F.col("band").isin(*bands))


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] = BANDS) -> DataFrame:
    """Long pixel table restricted to some bands."""
    return only_bands(spark.read.parquet(path), bands)


def write_raster(
    df: DataFrame,
    path: str,
    kind: str,
    keys: Sequence[str] = ("aoi_id",),
    dates: Sequence[str] = ("scene_date",),
    rows_per_part: int = TILE_ROWS,
    mode: str = "overwrite",
) -> None:
    """Write one raster kind, in at most ``curve.ZONES`` folders whatever the number of rasters.

    Blocks of rasters are dealt out to zones, a folder each, by a hash; inside, pixels are sorted by raster and
    then along a space-filling curve over tiles of ``rows_per_part`` rows and columns. The size of files follows
    the data: adaptive execution splits zones that are large and writes small ones in one task. A reader that
    names rasters and rows opens few folders (``read_window``, detection).

    Overwriting replaces the rasters (keys and dates) that ``df`` holds, whole; others stay. Folders that hold
    such a raster are written anew, which takes two passes over ``df``: it is computed once and kept on the
    executors' disks in between. Append rasters that are new.
    """
    ids = [*keys, *dates]
    zone = curve.zone_name(ids)
    block = [floor_div(F.col(axis), curve.BLOCK) for axis in ("row", "col")]
    rows = df.select(*ids, "row", "col", *KINDS[kind]).withColumn(zone, curve.zone_of({n: F.col(n) for n in ids}, *block))
    there = _stored(df.sparkSession, path) if mode == "overwrite" else None
    if there is None:
        _write_zones(rows, path, ids, rows_per_part, mode)
        return
    there = there.select(rows.columns)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    named = _replaced(rows, there, ids).persist()
    touched = _numbers(named.select(F.explode(F.array_union("added", "held"))))
    others = there.where(F.col(zone).isin(touched)).alias("there").join(named.alias("named"), _same(ids), "left_anti")
    added = _numbers(named.select(F.explode("added")))
    left = sorted(set(touched) - set(added))
    emptied = set(left) - set(_numbers(others.where(F.col(zone).isin(left)).select(zone).distinct())) if left else set()
    _write_zones(rows.unionByName(others), path, ids, rows_per_part, mode)
    for number in sorted(emptied):  # what was there is replaced, and nothing lies there now
        nothing = df.sparkSession.createDataFrame([], rows.drop(zone).schema)
        nothing.write.mode("overwrite").parquet(f"{path}/{zone}={number}")
    named.unpersist()
    rows.unpersist()


def _write_zones(rows: DataFrame, path: str, ids: Sequence[str], side: int, mode: str) -> None:
    zone = curve.zone_name(ids)
    (
        curve.along_curve(rows.hint("rebalance", F.col(zone)), side, [zone, *ids])
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(zone)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rasters in ``path``, if there are any."""
    try:
        return read_raster(spark, path)
    except AnalysisException as failed:
        if failed.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _same(ids: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"there.{n}").eqNullSafe(F.col(f"named.{n}")) for n in ids])


def _replaced(rows: DataFrame, there: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Each raster of ``rows``, the zones that it takes (``added``) and those that it has in ``there`` (``held``)."""
    zone = curve.zone_name(ids)
    both = rows.select(*ids, zone, F.lit(True).alias("new")).union(there.select(*ids, zone, F.lit(False)))
    sets = {"added": F.col("new"), "held": ~F.col("new")}
    zones = [F.collect_set(F.when(which, F.col(zone))).alias(name) for name, which in sets.items()]  # of at most ZONES
    return both.groupBy(*ids).agg(*zones).where(F.size("added") > 0)


def _numbers(zones: DataFrame) -> list[int]:
    """The distinct zones of a column, at most ``curve.ZONES`` numbers."""
    return sorted(row[0] for row in zones.distinct().collect())


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_window(
    spark: SparkSession, path: str, raster: Mapping[str, object], rows: tuple[int, int], cols: tuple[int, int]
) -> DataFrame:
    """Rows and columns ``rows`` and ``cols`` (first and last) of one raster, ``raster`` giving its keys and dates.

    Opens the folders of the window's blocks only, and reads of them the parts whose rows and columns may lie in it.
    """
    stored = read_raster(spark, path)
    zone = curve.zone_name(list(raster))
    ids = {name: F.lit(value) for name, value in raster.items()}
    first, last = ([limit[i] // curve.BLOCK for limit in (rows, cols)] for i in (0, 1))
    inside = F.col("row").between(*rows) & F.col("col").between(*cols)
    for name, value in ids.items():
        inside &= F.col(name).eqNullSafe(value.cast(stored.schema[name].dataType))
    found = stored.where(inside)
    if (last[0] - first[0] + 1) * (last[1] - first[1] + 1) <= curve.ZONES:  # else it may be in any zone
        blocks = product(*(range(a, b + 1) for a, b in zip(first, last)))
        found = found.where(F.col(zone).isin([curve.zone_of(ids, F.lit(r), F.lit(c)) for r, c in blocks]))
    return found.drop(zone)


def placeholder(
    missing: DataFrame,
    height: int = PLACEHOLDER_SIZE,
    width: int = PLACEHOLDER_SIZE,
    rgb: tuple[int, int, int] = PLACEHOLDER_RGB,
) -> DataFrame:
    """A constant raster per row of ``missing``."""
    colours = [F.lit(v).alias(n) for n, v in zip(("red", "green", "blue"), rgb)]
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")))
    cols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    lines = missing.withColumn("row", rows).repartition(fan_out(missing.sparkSession))
    return lines.withColumn("col", cols).select("*", *colours)


def with_placeholder(
    requests: DataFrame, rasters: DataFrame, keys: Sequence[str], known: DataFrame | None = None, **options
) -> DataFrame:
    """``rasters`` plus a placeholder for each requested key without a raster.

    ``known`` lists the rasters there are (raster_meta, say); without it all pixels are read to find out.
    """
    wanted = requests.select(*keys).distinct()
    there = rasters if known is None else known
    missing = wanted.join(there.select(*keys).distinct(), list(keys), "left_anti")
    columns = [*keys, "row", "col", "red", "green", "blue"]
    return rasters.select(*columns).unionByName(placeholder(missing, **options).select(*columns))
