"""Change-detection requests: polygon and date resolution, and distinct jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta.functions.rings import is_polygon, normalize_ring, ring_key
from terradelta.sources.aoi_library import DEFAULT_DATES

FALLBACK_DATES = tuple(DEFAULT_DATES)  # used when neither the request nor its AOI names one
REJECT_REASON = "AOI not in the library and no polygon given"
BAD_RING = "polygon needs three different points with two coordinates each"
BAD_DATE = "date is not yyyy-MM-dd"

SEARCH_DAYS = 5  # fixed value: days searched on either side of a target date


def date_window(day: Column, days: int = SEARCH_DAYS) -> list[Column]:
    """First and last calendar day of the window around ``day`` (yyyy-MM-dd string or date)."""
    parsed = day.try_cast("date")
    return [F.date_sub(parsed, days).alias("window_start"), F.date_add(parsed, days).alias("window_end")]


def _with_library(requests: DataFrame, aois: DataFrame) -> DataFrame:
    library = normalize_ring(aois, "coords").select(
        "aoi_id", F.col("coords").alias("library_coords"), "default_dates"
    )
    return normalize_ring(requests, "coords").join(library, "aoi_id", "left")


def _resolved_ring() -> Column:
    given = F.when(F.size("coords") > 0, F.col("coords"))
    return F.coalesce(given, F.col("library_coords"))


def resolve_aoi(requests: DataFrame, aois: DataFrame) -> DataFrame:
    """Requests with a polygon: their own if given, else the library's."""
    joined = _with_library(requests, aois).withColumn("coords", _resolved_ring())
    return joined.where(is_polygon(F.col("coords"))).drop("library_coords", "default_dates")


def _checked(requests: DataFrame, aois: DataFrame) -> DataFrame:
    """Requests with ring, dates (null where they can't be read) and why they are rejected (null if not)."""
    joined = _with_library(requests, aois).withColumn("coords", _resolved_ring())
    dated = joined.withColumns({name: day.try_cast("date") for name, day in _filled_dates(joined).items()})
    reason = (
        F.when(F.col("coords").isNull(), F.lit(REJECT_REASON))
        .when(~F.coalesce(is_polygon(F.col("coords")), F.lit(False)), F.lit(BAD_RING))
        .when(F.col("date1").isNull() | F.col("date2").isNull(), F.lit(BAD_DATE))
    )
    return dated.withColumn("reason", reason)


def rejected_requests(requests: DataFrame, aois: DataFrame) -> DataFrame:
    """Requests without a polygon, with a broken one, or with a date that can't be read; each with its reason."""
    return _checked(requests, aois).where("reason IS NOT NULL").select("request_id", "aoi_id", "reason")


def _library_date(df: DataFrame, i: int) -> Column:
    """Date ``i`` of default_dates, given as a struct or as a two-element array."""
    kind = df.schema["default_dates"].dataType
    if isinstance(kind, T.ArrayType):
        return F.get("default_dates", F.lit(i - 1))
    return F.col(f"default_dates.date{i}")


def _filled_dates(joined: DataFrame) -> dict[str, Column]:
    return {
        f"date{i}": F.coalesce(
            F.nullif(F.col(f"date{i}"), F.lit("")),
            F.nullif(_library_date(joined, i), F.lit("")),
            F.lit(FALLBACK_DATES[i - 1]),
        )
        for i in (1, 2)
    }


def default_dates(requests: DataFrame, aois: DataFrame) -> DataFrame:
    """Fill missing request dates from the AOI, else from the fallback constants."""
    joined = requests.join(aois.select("aoi_id", "default_dates"), "aoi_id", "left")
    return joined.withColumns(_filled_dates(joined)).drop("default_dates")


def resolve(requests: DataFrame, aois: DataFrame) -> DataFrame:
    """Ring and dates in one join with the library: request_id, aoi_id, ring_key, coords, dates."""
    good = _checked(requests, aois).where("reason IS NULL")
    return good.withColumn("ring_key", ring_key(F.col("coords"))).select(
        "request_id", "aoi_id", "ring_key", "coords", "date1", "date2"
    )


JOB = ("aoi_id", "ring_key", "date1", "date2")


def distinct_jobs(resolved: DataFrame) -> DataFrame:
    """One row per distinct (AOI, ring, dates); equal requests are computed once.

    ``job_id`` is a digest of what the job computes, so requests that share an id, or have none, keep their
    own jobs, and the same job has the same id in every batch. ``first_request`` is its smallest request_id.
    """
    distinct = resolved.groupBy(*JOB).agg(
        F.min("request_id").alias("first_request"), F.first("coords").alias("coords")
    )
    return distinct.withColumn("job_id", job_id())


def job_id() -> Column:
    """The digest of the columns JOB."""
    return F.xxhash64(*JOB)


def not_done(resolved: DataFrame, done: DataFrame) -> DataFrame:
    """Resolved requests whose job is not in the manifest ``done`` (column job_id)."""
    keyed = resolved.withColumn("job_id", job_id())
    return keyed.join(done.select("job_id"), "job_id", "left_anti").drop("job_id")
