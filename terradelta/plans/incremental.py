"""Batches of requests of which only what was not computed before is computed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.operators import requests
from terradelta.plans.detect import KEYS, detect_changes

MANIFEST = "job_id bigint, aoi_id string, date1 date, date2 date"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Jobs whose outputs are in the folder ``path``; none if there is no manifest yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def pending_jobs(requests_df: DataFrame, aois: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct jobs of the requests that are not in the manifest; no pixel is looked at."""
    return requests.distinct_jobs(requests.not_done(requests.resolve(requests_df, aois), done))


def run_pending(requests_df: DataFrame, pixels: DataFrame, aois: DataFrame, meta: DataFrame, path: str) -> int:
    """Compute the jobs whose outputs are not in ``path`` yet; returns how many there were to do.

    Appends the cleaned words (``words``) and the counts (``metrics``, one row per job) of all jobs with a
    result, and then their rows of the manifest. If nothing is pending no pixel is read. A batch is a folder named
    by a digest of its jobs, and the manifest is written last: a batch that broke off is not in the manifest, is
    done again, and replaces what it left. Jobs without a result stay pending, as their pixels may still come.
    """
    spark = requests_df.sparkSession
    done = read_manifest(spark, path)
    todo = pending_jobs(requests_df, aois, done).agg(F.count("*").alias("n"), F.bit_xor("job_id").alias("digest")).first()
    if not todo["n"]:
        return 0
    batch = f"batch={todo['digest'] & (1 << 64) - 1:016x}"
    found = detect_changes(requests_df, pixels, aois, meta, done)
    found.words.write.mode("overwrite").parquet(f"{path}/words/{batch}")
    found = replace(found, words=spark.read.schema(found.words.schema).parquet(f"{path}/words/{batch}"))
    found.job_metrics().write.mode("overwrite").parquet(f"{path}/metrics/{batch}")
    found.complete_jobs().select(*KEYS).write.mode("overwrite").parquet(f"{path}/manifest/{batch}")
    return todo["n"]
