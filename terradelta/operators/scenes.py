"""Scene search: catalogue products near a request in space and time, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions import rings
from terradelta.operators.requests import SEARCH_DAYS

# Product type searched for and number of candidates kept per request.
PRODUCT_TYPE = "S2MSI2A"
CANDIDATES = 5

CELL_DEGREES = 0.5  # edge of the grid cells that bucket the search; any size gives the same result


def to_cells(df: DataFrame, prefix: str, size: float, column: str | None = None) -> DataFrame:
    """One row per grid cell that the bounds touch, in cell_x and cell_y.

    Columns are counted around the globe, so that bounds beyond 180 degrees meet those beyond -180;
    ``column`` keeps the count along the bounds as well. ``size`` divides 360.
    """
    for axis in ("x", "y"):
        span = F.sequence(
            F.floor(F.col(f"{prefix}{axis}1") / size), F.floor(F.col(f"{prefix}{axis}2") / size)
        )
        df = df.withColumn(f"cell_{axis}", F.explode(span))
    kept = df.withColumn(column, F.col("cell_x")) if column else df
    return kept.withColumn("cell_x", F.pmod(F.col("cell_x"), F.lit(round(360 / size))))


def _cell_box(size: float) -> list[Column]:
    x, y = F.col("along"), F.col("cell_y")
    return [x * F.lit(size), y * F.lit(size), (x + 1) * F.lit(size), (y + 1) * F.lit(size)]


def wanted_cells(requests: DataFrame, days: int, cell: float) -> DataFrame:
    """Distinct (ring_key, target_date) requests per day of their window and cell they touch."""
    distinct = requests.groupBy("ring_key", "target_date").agg(F.first("coords").alias("coords"))
    shaped = rings.with_shape(distinct, rings.planar(rings.unwrapped(F.col("coords"))), "a_").drop("coords")
    touched = to_cells(shaped, "a_", cell, "along").where(rings.shape_meets_box("a_", _cell_box(cell)))
    window = F.sequence(F.date_sub("target_date", days), F.date_add("target_date", days))
    columns = [c for c in shaped.columns if c.startswith("a_")]
    return touched.select(
        "ring_key", "target_date", *columns, "cell_x", "cell_y", F.explode(window).alias("day")
    )


def offered_cells(catalog: DataFrame, cell: float, k: int) -> DataFrame:
    """Products per day and cell, without those that can be among nobody's first k.

    Every product that covers a whole cell matches every request that touches the cell, so of those
    only the k clearest per day matter. Of products with one footprint, which match the same
    requests, the same holds. A crowded cell or a much copied footprint thus shrinks to k rows, and
    Spark applies the limit before it shuffles (window group limit).
    """
    dated = catalog.select(
        "product_id", "sensing_start", "cloud_cover", "footprint", F.to_date("sensing_start").alias("day")
    ).withColumn("footprint_key", rings.ring_key(F.col("footprint")))
    shaped = rings.with_shape(dated, rings.planar(rings.unwrapped(F.col("footprint"))), "b_").drop("footprint")
    columns = [c for c in shaped.columns if c != "footprint_key"]
    covers = rings.shape_covers_box("b_", _cell_box(cell))
    group = F.when(~covers, F.col("footprint_key"))  # NULL: all products that cover the cell
    alike = Window.partitionBy("day", "cell_x", "cell_y", "alike").orderBy("cloud_cover", "product_id")
    return (
        to_cells(shaped, "b_", cell, "along")
        .select(*columns, "cell_x", "cell_y", group.alias("alike"))
        .withColumn("place", F.row_number().over(alike))
        .where(F.col("place") <= k)
        .drop("place", "alike")
    )


def candidate_scenes(
    requests: DataFrame,
    catalog: DataFrame,
    days: int = SEARCH_DAYS,
    cell: float = CELL_DEGREES,
    k: int = CANDIDATES,
) -> DataFrame:
    """Products that can be among the first k of each distinct (ring_key, target_date) request.

    Both sides meet in (day, cell) buckets, an equi join, and are then tested exactly. A pair that
    shares several cells appears once for each.
    """
    met = wanted_cells(requests, days, cell).join(offered_cells(catalog, cell, k), ["day", "cell_x", "cell_y"])
    return (
        rings.turned(met, "a_", "b_")
        .where(rings.shapes_meet("a_", "b_"))
        .select("ring_key", "target_date", "product_id", "sensing_start", "cloud_cover")
    )


def top_scenes(
    requests: DataFrame,
    catalog: DataFrame,
    days: int = SEARCH_DAYS,
    k: int = CANDIDATES,
    product_type: str = PRODUCT_TYPE,
    cell: float = CELL_DEGREES,
    how: str = "inner",
) -> DataFrame:
    """The k clearest matching products per request, with their rank (1 = clearest).

    Requests need aoi_id, coords (lon/lat ring) and target_date. Equal requests are searched once. With ``how``
    "left", requests without a product stay, with nulls.
    """
    typed = catalog.where(F.col("product_type") == product_type)
    keyed = requests.withColumn("ring_key", rings.ring_key(F.col("coords")))
    order = Window.partitionBy("ring_key", "target_date").orderBy("cloud_cover", "product_id")
    # repeats of a pair share its dense rank; dropping them needs no further exchange
    ranked = (
        candidate_scenes(keyed, typed, days, cell, k)
        .withColumn("rank", F.dense_rank().over(order))
        .where(F.col("rank") <= k)
        .dropDuplicates(["ring_key", "target_date", "product_id"])
    )
    return keyed.join(ranked, ["ring_key", "target_date"], how).drop("ring_key")


def select_scenes(requests: DataFrame, catalog: DataFrame, **options) -> DataFrame:
    """The best product per request."""
    return top_scenes(requests, catalog, **{**options, "k": 1}).drop("rank")
