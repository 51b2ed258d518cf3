"""The library of named areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.functions.rings import normalize_ring
from terradelta.schemas import AOIS

# Names, closed lon/lat rings and default dates of the built-in areas.
DEFAULT_DATES = ("2024-02-28", "2026-04-03")
RINGS = {
    "hinjewadi": [
        [73.856313, 18.544483],
        [73.875610, 18.544547],
        [73.877465, 18.534248],
        [73.856920, 18.534104],
        [73.856313, 18.544483],
    ],
    "bhosari": [
        [73.84385882396447, 18.636350807541707],
        [73.84389637489183, 18.633458476675234],
        [73.83920250897224, 18.63362113982318],
        [73.8379365062785, 18.636172897573907],
        [73.84385882396447, 18.636350807541707],
    ],
    "rajgurunagar": [
        [73.90927944074393, 18.872698337124664],
        [73.90421542996897, 18.848615946857674],
        [73.86494788879018, 18.847884892753193],
        [73.86108550769063, 18.87103339276428],
        [73.90927944074393, 18.872698337124664],
    ],
    "chakan": [
        [73.79452553399408, 18.78502442760771],
        [73.79312714208949, 18.75850012356941],
        [73.73761098347669, 18.758102889303412],
        [73.73346242082634, 18.78480377674],
        [73.79452553399408, 18.78502442760771],
    ],
}


def aoi_library(spark: SparkSession) -> DataFrame:
    """The built-in areas."""
    rows = [(name, ring, DEFAULT_DATES) for name, ring in RINGS.items()]
    return spark.createDataFrame(rows, AOIS)


def read_aois(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A library of areas from storage; rings may be wrapped in one extra list."""
    reader = spark.read.format(fmt)
    return normalize_ring((reader.schema(AOIS) if fmt == "json" else reader).load(path), "coords")


def list_aois(aois: DataFrame) -> DataFrame:
    """id, capitalised display name, ring and default dates of each area."""
    first = F.upper(F.substring("aoi_id", 1, 1))
    rest = F.lower(F.expr("substring(aoi_id, 2)"))
    return aois.select(
        F.col("aoi_id").alias("id"),
        F.concat(first, rest).alias("name"),
        F.col("coords").alias("coordinates"),
        "default_dates",
    )
