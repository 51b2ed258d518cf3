"""Change detection on two rendered images per area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions import spectral
from terradelta.operators import bands, bitrows, layers, metrics, morphology
from terradelta.operators.resize import resize_bilinear
from terradelta.sources.naming import legacy_artifact_names

CHANNELS = ("red", "green", "blue")
KERNEL = 5  # fixed value: neighbourhood of the mask opening


def fit_to_first(image2: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Image 2 at the size of image 1; rasters that already fit are passed through.

    ``sizes`` has the keys and src_width, src_height (image 2), dst_width, dst_height (image 1).
    """
    fits = (F.col("src_width") == F.col("dst_width")) & (F.col("src_height") == F.col("dst_height"))
    whole = bands.by_block(sizes.where(fits).select(*keys, "src_height"), keys, "src_height")
    same = image2.withColumn("block", bands.row_block("row")).join(whole, [*keys, "block"], "left_semi")
    resized = resize_bilinear(image2, sizes.where(~fits), CHANNELS, keys)
    return same.select(*resized.columns).unionByName(resized)


def gray_difference(
    image1: DataFrame, image2: DataFrame, keys: Sequence[str], halo: int
) -> DataFrame:
    """Absolute luma difference per pixel, in one aggregation instead of a self join.

    Rows are laid out by word, so packing the result needs no further exchange.
    """
    both = (
        image1.select(*keys, "row", "col", F.lit(1).alias("side"), *CHANNELS)
        .unionByName(image2.select(*keys, "row", "col", F.lit(2).alias("side"), *CHANNELS))
        .withColumn("gray", spectral.grayscale(*[F.col(c) for c in CHANNELS]))
        .drop(*CHANNELS)
    )
    placed = bitrows.with_address(both, halo).repartition(*keys, *bitrows.ADDRESS)
    sides = [F.max(F.when(F.col("side") == i, F.col("gray"))).alias(f"gray{i}") for i in (1, 2)]
    return (
        placed.groupBy(*keys, *bitrows.ADDRESS, "col")
        .agg(*sides)
        .withColumn("difference", spectral.absolute_difference(F.col("gray1"), F.col("gray2")))
    )


def legacy_words(
    image1: DataFrame, image2: DataFrame, keys: Sequence[str] = ("aoi_id",)
) -> tuple[DataFrame, int]:
    """Cleaned packed change masks of two images of equal size, and their halo."""
    steps = morphology.opening(KERNEL)
    halo = morphology.halo_of(steps)
    change = gray_difference(image1, image2, keys, halo)
    flags = {"mask": F.col("difference") > spectral.GRAY_THRESHOLD}
    words = bitrows.pack(change, keys, flags, halo)
    return morphology.transform_words(words, keys, ["mask"], steps), halo


def legacy_metrics(words: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Counts, percentage and area (four digits) per key."""
    counts = words.groupBy(*keys).agg(
        F.sum(F.bit_count("present")).cast("long").alias("total_pixels"),
        F.sum(F.bit_count("mask")).cast("long").alias("changed_pixels"),
    )
    return metrics.with_change(counts, digits=4)


def legacy_document(counted: DataFrame, day: Column | str = "date2") -> DataFrame:
    """Nested document per area: counts, percentage, area and the names of the three images made from it."""
    names = legacy_artifact_names(F.col("aoi_id"), F.col(day) if isinstance(day, str) else day)
    files = F.struct(*[names[kind].alias(kind) for kind in ("processed", "clean_map", "comparison")])
    return counted.select(
        "aoi_id", "total_pixels", "changed_pixels", "change_percentage", "changed_area_km2", files.alias("filenames")
    )


def detect_changes_legacy(
    image1: DataFrame, image2: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("aoi_id",)
) -> DataFrame:
    """Resize, grey difference, threshold, opening and metrics for every pair of images."""
    words, _ = legacy_words(image1, fit_to_first(image2, sizes, keys), keys)
    return legacy_metrics(words, keys)


def comparison_strip(
    image1: DataFrame, image2: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("aoi_id",)
) -> DataFrame:
    """Image 1, image 2 and the cleaned mask side by side."""
    fitted = fit_to_first(image2, sizes, keys)
    words, halo = legacy_words(image1, fitted, keys)
    mask = bitrows.unpack(words, keys, ["mask"], halo)
    mask = mask.select(*keys, "row", "col", *spectral.mask_to_rgb(F.col("mask")))
    widths = sizes.select(*keys, F.col("dst_width").alias("width"), F.col("dst_height").alias("height"))
    return layers.side_by_side([image1, fitted, mask], widths, keys)
