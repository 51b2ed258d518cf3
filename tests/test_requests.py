from datetime import date

from pyspark.sql import functions as F

from terradelta.operators import requests as rq
from terradelta.schemas import REQUESTS
from terradelta.sources import naming
from terradelta.sources.aoi_library import aoi_library, list_aois

OWN = [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 2.0]]


def asked(spark):
    return spark.createDataFrame(
        [
            (1, "chakan", "2024-01-01", None, None),
            (2, "nowhere", None, "2025-01-01", None),
            (3, "nowhere", None, None, OWN),
            (4, "chakan", "2024-01-01", "", []),
            (5, "chakan", "2024-01-01", "2026-04-03", None),
        ],
        REQUESTS,
    )


def test_rings_and_rejections(spark):
    aois = aoi_library(spark)
    got = {r.request_id: r.coords for r in rq.resolve_aoi(asked(spark), aois).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3] == OWN and got[1] == got[4]
    rejected = rq.rejected_requests(asked(spark), aois).collect()
    assert [(r.request_id, r.aoi_id) for r in rejected] == [(2, "nowhere")]


def test_dates_from_struct_array_and_fallback(spark):
    aois = aoi_library(spark)
    got = {r.request_id: (r.date1, r.date2) for r in rq.default_dates(asked(spark), aois).collect()}
    assert got[1] == got[4] == ("2024-01-01", "2026-04-03")
    assert got[2] == ("2024-02-28", "2025-01-01")
    arrays = aois.withColumn("default_dates", F.array(F.lit("2020-01-01"), F.lit("2021-01-01")))
    got = {r.request_id: (r.date1, r.date2) for r in rq.default_dates(asked(spark), arrays).collect()}
    assert got[1] == ("2024-01-01", "2021-01-01") and got[3] == ("2024-02-28", "2026-04-03")
    short = aois.withColumn("default_dates", F.array(F.lit("2020-01-01")))
    got = {r.request_id: r.date2 for r in rq.default_dates(asked(spark), short).collect()}
    assert got[1] == "2026-04-03"


def test_equal_requests_are_one_job(spark):
    jobs = rq.distinct_jobs(rq.resolve(asked(spark), aoi_library(spark))).collect()
    assert sorted(j.first_request for j in jobs) == [1, 3] and len({j.job_id for j in jobs}) == 2
    assert {j.date1 for j in jobs} == {date(2024, 1, 1), date(2024, 2, 28)}


def test_listing_and_names(spark):
    names = {r.id: r.name for r in list_aois(aoi_library(spark)).collect()}
    assert names["hinjewadi"] == "Hinjewadi" and len(names) == 4
    df = spark.createDataFrame([("New Town", "2024-05-06")], "place string, day string")
    legacy = naming.legacy_artifact_names(F.col("place"), F.col("day"))
    row = df.select(*[c.alias(n) for n, c in legacy.items()]).collect()[0]
    assert row.raw == "raw_new_town_2024-05-06_2024.png"
    assert row.clean_map == "clean_change_map_new_town_2024-05-06_2024.png"


def test_resolve_uri(spark):
    rows = [("/a",), ("http://x/a",), ("a",), (None,), ("",)]
    df = spark.createDataFrame(rows, "u string")
    got = [r[0] for r in df.select(naming.resolve_uri(F.col("u"), "http://h")).collect()]
    assert got == ["http://h/a", "http://x/a", "a", None, ""]


def test_date_window(spark):
    df = spark.createDataFrame([("2024-02-28",)], "d string").select(*rq.date_window(F.col("d")))
    assert tuple(df.collect()[0]) == (date(2024, 2, 23), date(2024, 3, 4))
