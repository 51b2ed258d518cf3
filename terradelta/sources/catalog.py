"""Scene catalogue, scene assets and the list of assets already present."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.operators.scenes import PRODUCT_TYPE
from terradelta.schemas import CATALOG

# File name parts of the 10 m bands.
ASSET_BANDS = ("B02_10m", "B03_10m", "B04_10m", "B08_10m")
ASSET_SUFFIX = ".jp2"


def of_type(catalog: DataFrame, product_type: str = PRODUCT_TYPE) -> DataFrame:
    return catalog.where(F.col("product_type") == product_type)


def read_catalog(
    spark: SparkSession, path: str, product_type: str = PRODUCT_TYPE, fmt: str = "parquet"
) -> DataFrame:
    """Catalogue rows of one product type; the filter is pushed to the scan."""
    return of_type(spark.read.format(fmt).schema(CATALOG).load(path), product_type)


def asset_paths(scenes: DataFrame, bands: Sequence[str] = ASSET_BANDS) -> DataFrame:
    """One row per scene and band with its storage key."""
    key = F.concat("scene", "granule", "prefix", F.lit("_"), "asset_band", F.lit(ASSET_SUFFIX))
    return scenes.withColumn(
        "asset_band", F.explode(F.array(*[F.lit(b) for b in bands]))
    ).withColumn("asset_key", key)


def pending(assets: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("asset_key",)) -> DataFrame:
    """Assets not in the manifest yet."""
    return assets.join(manifest.select(*keys), list(keys), "left_anti")
