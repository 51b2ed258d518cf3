"""Bilinear resampling of rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.numbers import int_div
from terradelta.operators.bands import by_block, row_block


def _targets(at: str, src: str, dst: str) -> Column:
    """Target indices that the source index ``at`` may contribute to."""
    i, s, d = F.col(at), F.col(src), F.col(dst)
    low = F.floor((((i * 2 - 1) * d) / s - 1) / 2)
    high = F.ceil((((i * 2 + 3) * d) / s - 1) / 2)
    zero = F.lit(0).cast("long")
    first = F.when(i == 0, zero).otherwise(F.least(F.greatest(low, zero), d - 1))
    last = F.when(i == s - 1, d - 1).otherwise(F.greatest(F.least(high, d - 1), zero))
    return F.sequence(first, F.greatest(first, last))


def _weight(target: Column, at: Column, src: Column, dst: Column) -> Column:
    """Share of source index ``at`` in ``target``, in units of 1 / (2 * dst); may be <= 0.

    Centres are aligned: target t samples source position (t + 0.5) * src / dst - 0.5, clamped.
    """
    position = (target * 2 + 1) * src - dst
    clamped = F.least(F.greatest(position, F.lit(0).cast("long")), (src - 1) * dst * 2)
    return dst * 2 - F.abs(clamped - at * dst * 2)


def resize_bilinear(
    df: DataFrame, sizes: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("aoi_id",)
) -> DataFrame:
    """Resample each raster to a new size.

    ``sizes`` has the keys and src_width, src_height, dst_width, dst_height (bigint). Source pixels
    meet the sizes by blocks of rows and push their weighted value to the few targets they touch, whose
    sums are pre-aggregated before they shuffle by target pixel; weights are integers, so the result is exact.
    """
    rows = (
        df.withColumn("block", row_block("row"))
        .join(by_block(sizes, keys, "src_height"), [*keys, "block"])
        .drop("block")
        .withColumn("t_row", F.explode(_targets("row", "src_height", "dst_height")))
        .withColumn("w_row", _weight(F.col("t_row"), F.col("row"), F.col("src_height"), F.col("dst_height")))
        .where("w_row > 0")
        .withColumn("t_col", F.explode(_targets("col", "src_width", "dst_width")))
        .withColumn("w_col", _weight(F.col("t_col"), F.col("col"), F.col("src_width"), F.col("dst_width")))
        .where("w_col > 0")
    )
    weight = F.col("w_row") * F.col("w_col")
    total = F.first("dst_width") * F.first("dst_height") * 4
    summed = rows.groupBy(*keys, F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg(
        *[F.sum(F.col(c) * weight).alias(c) for c in channels], total.alias("unit")
    )
    return summed.select(
        *keys,
        "row",
        "col",
        *[int_div(F.col(c) * 2 + F.col("unit"), F.col("unit") * 2).cast("int").alias(c) for c in channels],
    )
