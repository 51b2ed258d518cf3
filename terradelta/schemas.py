"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

RING = T.ArrayType(T.ArrayType(T.DoubleType()))

AOIS = T.StructType(
    [
        T.StructField("aoi_id", T.StringType(), False),
        T.StructField("coords", RING, False),
        T.StructField(
            "default_dates",
            T.StructType(
                [T.StructField("date1", T.StringType()), T.StructField("date2", T.StringType())]
            ),
        ),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType(), False),
        T.StructField("aoi_id", T.StringType(), False),
        T.StructField("date1", T.StringType()),
        T.StructField("date2", T.StringType()),
        T.StructField("coords", RING),
    ]
)

PIXELS = T.StructType(
    [
        T.StructField("aoi_id", T.StringType(), False),
        T.StructField("scene_date", T.DateType(), False),
        T.StructField("band", T.StringType(), False),
        T.StructField("row", T.LongType(), False),
        T.StructField("col", T.LongType(), False),
        T.StructField("dn", T.IntegerType(), False),
    ]
)

RASTER_META = T.StructType(
    [
        T.StructField("aoi_id", T.StringType(), False),
        T.StructField("epsg", T.IntegerType(), False),
        T.StructField("x0", T.DoubleType(), False),
        T.StructField("y0", T.DoubleType(), False),
        T.StructField("px", T.DoubleType(), False),
        T.StructField("py", T.DoubleType(), False),
        T.StructField("width", T.LongType(), False),
        T.StructField("height", T.LongType(), False),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("product_id", T.LongType(), False),
        T.StructField("sensing_start", T.TimestampNTZType(), False),
        T.StructField("product_type", T.StringType(), False),
        T.StructField("cloud_cover", T.DoubleType(), False),
        T.StructField("footprint", RING, False),
    ]
)
