"""From requests to the scene assets that still have to be fetched."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.operators.scenes import select_scenes
from terradelta.sources.catalog import asset_paths, pending
from terradelta.sources.rasters import placeholder

#: Outcomes of the search for a request.
CHOSEN, UNMATCHED, UNLOCATED = "chosen", "unmatched", "unlocated"


@dataclass
class ScenePlan:
    """What one ranked search found: a row per request with its outcome, best product and that one's scene."""

    outcome: DataFrame  # the requests with outcome, product_id, sensing_start, cloud_cover, scene, granule, prefix
    manifest: DataFrame  # assets that are there already

    def materialized(self, path: str) -> ScenePlan:
        """Write the outcome to ``path``, which all executors share, so that its readers do not search again."""
        self.outcome.write.parquet(path)
        stored = self.outcome.sparkSession.read.schema(self.outcome.schema).parquet(path)
        return replace(self, outcome=stored)

    @property
    def chosen(self) -> DataFrame:
        """The best product per request, whether its files are known or not."""
        return self.outcome.where(F.col("outcome") != UNMATCHED).drop("outcome", "scene", "granule", "prefix")

    @property
    def unmatched(self) -> DataFrame:
        """Requests without any product: they get a placeholder raster."""
        return self.outcome.where(F.col("outcome") == UNMATCHED).select("aoi_id", "target_date", "coords")

    @property
    def unlocated(self) -> DataFrame:
        """Chosen products that have no scene row."""
        return self.outcome.where(F.col("outcome") == UNLOCATED).select("product_id").distinct()

    @property
    def to_fetch(self) -> DataFrame:
        """Distinct assets of the chosen products that are not in the manifest."""
        found = self.outcome.where(F.col("outcome") == CHOSEN)
        products = found.select("product_id", "scene", "granule", "prefix").distinct()
        return pending(asset_paths(products), self.manifest)

    def placeholders(self, **options) -> DataFrame:
        """A constant raster for each unmatched request."""
        return placeholder(self.unmatched.select("aoi_id", "target_date").distinct(), **options)


def plan_scenes(
    requests: DataFrame, catalog: DataFrame, scenes: DataFrame, manifest: DataFrame, **options
) -> ScenePlan:
    """Select scenes in one outer search and look up their files.

    ``scenes`` maps product_id to its scene, granule and prefix. Assets are keyed by product, so a product
    chosen by many requests is fetched once. Requests need aoi_id, coords and target_date.
    """
    found = select_scenes(requests, catalog, how="left", **options)
    located = found.join(scenes.select("product_id", "scene", "granule", "prefix"), "product_id", "left")
    outcome = F.when(F.col("product_id").isNull(), UNMATCHED).when(F.col("scene").isNull(), UNLOCATED).otherwise(CHOSEN)
    return ScenePlan(located.withColumn("outcome", outcome), manifest)
