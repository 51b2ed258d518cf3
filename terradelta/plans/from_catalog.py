"""Change detection on the clearest scenes of a catalogue, for polygons anywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.rings import ring_key
from terradelta.operators import bands, layers, mosaic, morphology, requests, scenes
from terradelta.operators.requests import SEARCH_DAYS
from terradelta.plans.detect import KEYS, Detection, cleaned_words

NO_RASTER = "no raster of the chosen scenes holds the polygon"


@dataclass(kw_only=True)
class CatalogDetection(Detection):
    """Results for requests whose scenes were chosen from a catalogue; rows and columns are those of a lattice."""

    chosen: DataFrame  # ring_key, target_date, product_id, rank: the scenes of each ring and date, clearest first
    sources: DataFrame  # job_id, slot, raster_id, rank: the rasters that a job reads
    days: int = SEARCH_DAYS

    def scenes(self) -> DataFrame:
        """The products that each request's two dates are taken from, in the order in which they are used."""
        asked = self.resolved.select("request_id", *requests.JOB).join(self.jobs.select("job_id", *requests.JOB), list(requests.JOB))
        used = asked.join(self.sources, "job_id")
        return used.select("request_id", "aoi_id", (F.col("slot") + 1).alias("date"), F.col("raster_id").alias("product_id"), "rank")

    def unserved(self) -> DataFrame:
        """Resolved requests without a result: a date without a scene is named, else what the rasters lack."""
        served = self.complete_jobs().join(self.jobs, list(KEYS)).select(*requests.JOB)
        missing = self.resolved.join(served, list(requests.JOB), "left_anti")
        found = self.chosen.select("ring_key", "target_date").distinct()
        lacking = missing
        for i in (1, 2):
            seen = found.select("ring_key", F.col("target_date").alias(f"date{i}"), F.lit(True).alias(f"seen{i}"))
            lacking = lacking.join(seen, ["ring_key", f"date{i}"], "left")
        said = lacking.join(self._gaps(), list(requests.JOB), "left")
        dates = F.array_distinct(F.array_compact(F.array(*(self._unseen(i) for i in (1, 2)))))
        reason = F.when(F.size(dates) > 0, F.array_join(dates, "; ")).otherwise(F.coalesce("reason", F.lit(NO_RASTER)))
        return said.select("request_id", "aoi_id", reason.alias("reason"))

    def _unseen(self, i: int) -> Column:
        near = F.concat(F.lit(f"no scene within {self.days} days of "), F.col(f"date{i}").cast("string"))
        return F.when(F.col(f"seen{i}").isNull(), near)


def detect_from_catalog(
    requests_df: DataFrame,
    pixels: DataFrame,
    aois: DataFrame,
    catalog: DataFrame,
    frames: DataFrame,
    days: int = SEARCH_DAYS,
    k: int = scenes.CANDIDATES,
    path: str | None = None,
    **options,
) -> CatalogDetection:
    """Run all requests, each date on the scenes nearest in time and clearest in view.

    Dates need no scene of their own, and areas no raster of their own name: the k clearest products within
    ``days`` days of a date whose footprint meets the polygon are its sources, and every pixel is taken from the
    clearest of them that has it. So a polygon over two rasters is served, and one inside the clearest scene
    comes from that alone. ``pixels`` are wide and keyed by product: raster_id, row, col, b02, b03, b04, b08;
    ``frames`` place each product (raster_id) on the map. Rasters of a CRS that is not supported are passed
    over, as are those that don't fall into line with the clearest scene of the first date. With ``path``, a new
    folder that all executors share, the outcome of the scene search is written there first, so that the many
    readers of it do not search again; else everything stays lazy.
    """
    resolved = requests.resolve(requests_df, aois)
    rejected = requests.rejected_requests(requests_df, aois)
    asked = requests.distinct_jobs(resolved)
    slots = asked.select("*", F.posexplode(F.array("date1", "date2")).alias("slot", "target_date"))
    targets = slots.groupBy("ring_key", "target_date").agg(F.first("coords").alias("coords"))
    chosen = scenes.top_scenes(targets.drop("ring_key"), catalog, days, k, **options)
    chosen = chosen.select(ring_key(F.col("coords")).alias("ring_key"), "target_date", "product_id", "rank")
    offered = slots.join(chosen.withColumnRenamed("product_id", "raster_id"), ["ring_key", "target_date"])
    sources = mosaic.with_windows(mosaic.placed(offered, frames), ["job_id"], ["slot", "rank", "raster_id"], 2)
    if path is not None:
        chosen, sources = mosaic.written(chosen, f"{path}/chosen"), mosaic.written(sources, f"{path}/sources")
    jobs = mosaic.windows_of(sources, ["job_id"], ["first_request", *requests.JOB, "coords"])
    halo = morphology.halo_of(layers.OVERLAY_STEPS)
    cut = mosaic.cut(pixels, jobs, sources, KEYS, halo, bands.BAND_COLUMNS, 2)
    names = {f"{b}_{i}": f"{b}_{i + 1}" for i in (1, 0) for b in bands.BAND_COLUMNS}
    pairs = cut.select(*KEYS, "tile_row", "word", "row", "col", *[F.col(a).alias(b) for a, b in names.items()])
    words = cleaned_words(pairs, halo)
    frame = jobs.select("job_id", "epsg", "px", "py", F.col("lattice_x0").alias("x0"), F.col("lattice_y0").alias("y0"))
    used = sources.select("job_id", "slot", "raster_id", "rank")
    return CatalogDetection(
        resolved, rejected, jobs, pairs, words, frame, halo, ("job_id",), chosen=chosen, sources=used, days=days
    )
