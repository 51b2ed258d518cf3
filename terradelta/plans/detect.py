"""Change detection for many requests in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.operators import (
    bands,
    bitrows,
    layers,
    metrics,
    morphology,
    regions,
    requests,
    sampling,
)
from terradelta.functions import projection
from terradelta.functions.numbers import floor_div
from terradelta.sources.curve import zone_name, zones_of_window
from terradelta.sources.rasters import only_bands

KEYS = ("job_id", "aoi_id", "date1", "date2")
KERNEL = 3  # fixed value: neighbourhood of the mask cleaning
UNSERVED_REASON = "no pixels of both dates inside the polygon"


def _issues() -> Column:
    """What a job's rectangle lacks, from its pixels and the values counted in n_*: bands, or pixels of a date."""
    area, found = F.col("crop_width") * F.col("crop_height"), []
    for i in (1, 2):
        counts = {band: F.col(f"n_{name}_{i}") for band, name in zip(bands.BANDS, bands.BAND_COLUMNS)}
        day = F.col(f"date{i}").cast("string")
        least, most = F.least(*counts.values()), F.greatest(*counts.values())
        found.append(F.when(most == 0, F.concat(F.lit("no pixels on "), day)))
        for band, n in counts.items():
            found.append(F.when((n == 0) & (most > 0), F.concat(F.lit(f"missing band {band} on "), day)))
        part = F.concat(least.cast("string"), F.lit(" of "), area.cast("string"), F.lit(" pixels on "), day)
        found.append(F.when((least > 0) & (least < area), part))
    return F.array_join(F.array_distinct(F.array_compact(F.array(*found))), "; ")


@dataclass
class Detection:
    """Results of a batch of requests, all lazy: nothing runs before one of them is read or written.

    Only jobs whose rectangle is complete, every pixel with all bands on both dates, have results.
    """

    resolved: DataFrame  # request_id, aoi_id, ring_key, coords, date1, date2
    rejected: DataFrame  # request_id, aoi_id, reason
    jobs: DataFrame  # distinct work items with their placed ring and crop window; first_request names one that asks
    pairs: DataFrame  # clipped pixels of both dates per job, laid out by word
    words: DataFrame  # cleaned packed masks per job
    meta: DataFrame
    halo: int
    framed_by: tuple[str, ...] = ("aoi_id",)  # what names a row of meta

    def materialized(self, path: str) -> Detection:
        """Write the packed masks to ``path``, which all executors share, so that several results do not read the pixels again."""
        self.words.write.parquet(path)
        return replace(self, words=self.words.sparkSession.read.schema(self.words.schema).parquet(path))

    def complete_jobs(self) -> DataFrame:
        """Keys of the jobs whose rectangle is complete."""
        full = self.words.groupBy(*KEYS).agg(F.sum(F.bit_count("complete")).alias("complete"))
        area = self.jobs.select("job_id", (F.col("crop_width") * F.col("crop_height")).alias("area"))
        return full.join(area, "job_id").where("complete = area").select(*KEYS)

    def complete_words(self) -> DataFrame:
        return self.words.join(self.complete_jobs(), list(KEYS), "left_semi")

    def _gaps(self) -> DataFrame:
        """What the rectangles of jobs lack."""
        values = [F.count(f"{b}_{i}").alias(f"n_{b}_{i}") for i in (1, 2) for b in bands.BAND_COLUMNS]
        counted = self.pairs.groupBy("job_id").agg(*values)
        judged = self.jobs.join(counted, "job_id").withColumn("reason", _issues()).where("reason <> ''")
        return judged.select(*requests.JOB, "reason")

    def incomplete(self) -> DataFrame:
        """Requests whose rectangle lacks pixels or bands, with what it lacks."""
        asked = self.resolved.select("request_id", *requests.JOB)
        return asked.join(self._gaps(), list(requests.JOB)).select("request_id", "aoi_id", "reason")

    def job_metrics(self) -> DataFrame:
        """One row per job: counts, areas and class areas."""
        counts = metrics.count_words(self.words, KEYS)
        per_job = metrics.with_class_areas(metrics.with_change(counts))
        area = (F.col("crop_width") * F.col("crop_height")).alias("area")
        whole = per_job.join(self.jobs.select("job_id", "ring_key", area), "job_id").where("complete_pixels = area")
        return whole.drop("area", "complete_pixels")

    def metrics(self) -> DataFrame:
        """One row per request: counts, areas and class areas."""
        asked = self.resolved.select("request_id", *requests.JOB)
        return asked.join(self.job_metrics().drop("job_id"), list(requests.JOB)).drop("ring_key")

    def unserved(self) -> DataFrame:
        """Resolved requests without a result: no raster, no scene of one of the dates, or an incomplete rectangle."""
        served = self.complete_jobs().join(self.jobs, list(KEYS)).select(*requests.JOB)
        missing = self.resolved.join(served, list(requests.JOB), "left_anti")
        # a job that lacks all pixels of one date keeps the general reason unless the other date has gaps of its own
        why = self._gaps().where("reason NOT RLIKE '^no pixels on [-0-9]+(; no pixels on [-0-9]+)?$'")
        unknown = F.concat(F.lit(f"{projection.UNSUPPORTED}: EPSG "), "epsg").alias("unknown")
        off_map = self.meta.where(~projection.is_supported(F.col("epsg"))).select("aoi_id", unknown).distinct()
        told = missing.join(why, list(requests.JOB), "left").join(off_map, "aoi_id", "left")
        return told.select("request_id", "aoi_id", F.coalesce("reason", "unknown", F.lit(UNSERVED_REASON)).alias("reason"))

    def masks(self) -> DataFrame:
        """The cleaned mask and the three classes per pixel, as 0/1."""
        classes = metrics.class_words()
        words = self.complete_words().withColumns(classes)
        return bitrows.unpack(words, KEYS, ["mask", *classes], self.halo)

    def rasters(self) -> DataFrame:
        """Display colours, ndvi and ndwi of both dates of each job: kinds rgb, ndvi and ndwi of the raster sink."""
        pairs = bands.with_indices(self.pairs.join(self.complete_jobs(), list(KEYS), "left_semi"))
        dates = [
            F.struct(
                F.col(f"date{i}").alias("scene_date"),
                *[c.alias(n) for n, c in zip(("red", "green", "blue"), bands.rgb_of(i))],
                F.col(f"ndvi_{i}").alias("ndvi"),
                F.col(f"ndwi_{i}").alias("ndwi"),
            )
            for i in (1, 2)
        ]
        return pairs.select(*KEYS, "row", "col", F.inline(F.array_distinct(F.array(*dates))))

    def overlay(self) -> DataFrame:
        """Date-2 colours with the changes painted on them."""
        pairs = self.pairs.join(self.complete_jobs(), list(KEYS), "left_semi")
        return layers.overlay_of_words(pairs, self.complete_words(), KEYS, self.halo)

    def bounds(self) -> DataFrame:
        """Lon/lat bounds and centre of each job's cropped rectangle."""
        frame = {"x0": "crop_x0", "y0": "crop_y0", "width": "crop_width", "height": "crop_height"}
        cropped = self.jobs.select(*KEYS, "epsg", "px", "py", *[F.col(c).alias(n) for n, c in frame.items()])
        return regions.bounds_center(cropped, KEYS)

    def features(self, k: int = sampling.SAMPLE_SIZE) -> DataFrame:
        """Border and sampled points of each job as styled GeoJSON features."""
        points = layers.lonlat_points(self.points(k), self.meta, self.framed_by)
        return layers.feature_layers(self.jobs, points, KEYS)

    def documents(self, base_uri: str) -> DataFrame:
        return metrics.metrics_document(self.metrics(), base_uri)

    def points(self, k: int = sampling.SAMPLE_SIZE) -> DataFrame:
        """Evenly spaced pixels of the two displayed classes per job."""
        classes = metrics.class_words()
        shown = {c: classes[c] for c in ("new_construction", "surface_water")}
        long = sampling.class_long(self.complete_words(), KEYS, shown)
        keys = [*KEYS, "class"]
        return sampling.even_sample(sampling.rank_words(long, keys), keys, self.halo, k)


def prepare_jobs(resolved: DataFrame, meta: DataFrame) -> DataFrame:
    """Distinct work items, projected onto their raster and cropped to it.

    A small table; the exchanges that its readers share are computed once.
    """
    placed = regions.place_rings(requests.distinct_jobs(resolved), meta)
    columns = ["job_id", "first_request", *requests.JOB, "coords", "ring"]
    window = ["row_min", "row_max", "col_min", "col_max", "crop_width", "crop_height"]
    window += ["epsg", "crop_x0", "crop_y0", "px", "py"]
    jobs = regions.crop_window(placed).select(*columns, *window)
    return regions.touching(jobs)


def pixels_in_reach(pixels: DataFrame, jobs: DataFrame) -> DataFrame:
    """Drop pixels of tiles and dates no job needs, before they are laid out.

    Always a semi join on (raster, date, tile_row), and for pixels that ``write_raster`` stored on the zone of
    their block too, which keeps the folders of other zones from being read. Spark chooses how to join by measured
    sizes. The list of tiles is dealt out by the whole key: left where the jobs are, by raster alone, it would draw
    the pixels there.
    """
    ids = ["aoi_id", "scene_date"]
    zone = zone_name(ids)
    on = [*ids, "tile_row"]
    tiles = F.sequence(floor_div(F.col("row_min"), bitrows.TILE_ROWS), floor_div(F.col("row_max"), bitrows.TILE_ROWS))
    needed = bands.by_date(jobs.select("aoi_id", "date1", "date2", "col_min", "col_max", F.explode(tiles).alias("tile_row")))
    if zone in pixels.columns:
        zones = zones_of_window(ids, F.col("tile_row"), bitrows.TILE_ROWS, F.col("col_min"), F.col("col_max"))
        needed, on = needed.withColumn(zone, F.explode(zones)), [*on, zone]
    if "tile_row" not in pixels.columns:
        pixels = pixels.withColumn("tile_row", floor_div(F.col("row"), bitrows.TILE_ROWS))
    return pixels.join(needed.select(*on).repartition(*on).distinct(), on, "left_semi")


def clipped_pairs(pixels: DataFrame, jobs: DataFrame, halo: int) -> DataFrame:
    """Both dates of each job's clipped rectangle, one row per pixel seen on any of them.

    Pixels are laid out once, by (raster, tile_row, word, row). Stacking, clipping and pairing all group or
    join on supersets of that key, so they stay in place; the date is part of the join with the burned
    masks, so a pixel meets only the jobs that ask for its date.
    """
    long = "band" in pixels.columns
    near = pixels_in_reach(only_bands(pixels) if long else pixels, jobs)
    layout = ["aoi_id", *bitrows.ADDRESS]
    placed = bitrows.with_address(near, halo).repartition(*layout)
    stacked = bands.stack_bands(placed) if long else placed
    masks = bands.by_date(regions.burn(jobs, KEYS, halo)).repartition(*layout)
    clipped = regions.clip(stacked, masks, ["aoi_id", "scene_date"], halo, bands.BAND_COLUMNS)
    return bands.pair_columns(clipped, ["job_id", "aoi_id"], bands.BAND_COLUMNS, partial=True)


def cleaned_words(pairs: DataFrame, halo: int) -> DataFrame:
    """Packed masks of paired pixels: cleaned changes, and the flags of their classes and of completeness."""
    words = bitrows.pack(pairs, KEYS, bands.change_flags(), halo)
    steps = morphology.cleaning(KERNEL)
    return morphology.transform_words(words, KEYS, ["mask"], steps, ["complete", "vegetation", "water"], halo)


def detect_changes(
    requests_df: DataFrame, pixels: DataFrame, aois: DataFrame, meta: DataFrame, done: DataFrame | None = None
) -> Detection:
    """Run all requests, without those whose job is in the manifest ``done`` (column job_id).

    ``pixels`` is long (aoi_id, scene_date, band, row, col, dn) or, a quarter of the rows to shuffle,
    wide (aoi_id, scene_date, row, col, b02, b03, b04, b08). ``meta`` places each raster on the map.
    Requests without dates take their AOI's; those without a known polygon are rejected.
    """
    resolved = requests.resolve(requests_df, aois)
    resolved = resolved if done is None else requests.not_done(resolved, done)
    rejected = requests.rejected_requests(requests_df, aois)
    jobs = prepare_jobs(resolved, meta)
    halo = morphology.halo_of(layers.OVERLAY_STEPS)
    pairs = clipped_pairs(pixels, jobs, halo)
    words = cleaned_words(pairs, halo)
    return Detection(resolved, rejected, jobs, pairs, words, meta, halo)
