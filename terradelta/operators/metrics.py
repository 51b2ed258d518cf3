"""Change counts, areas and the metrics document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.numbers import area_km2, percent
from terradelta.sources.naming import artifact_uris


def class_words() -> dict[str, Column]:
    """Class masks of cleaned, owned words (vegetation and water may overlap)."""
    mask, vegetation, water = F.col("mask"), F.col("vegetation"), F.col("water")
    return {
        "vegetation_loss": mask.bitwiseAND(vegetation),
        "surface_water": mask.bitwiseAND(water),
        "new_construction": mask.bitwiseAND(F.bitwise_not(vegetation.bitwiseOR(water))),
    }


def count_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel counts per key from cleaned, owned words; with complete_pixels if the words say which are."""

    def total(bits: Column) -> Column:
        return F.sum(F.bit_count(bits)).cast("long")

    classes = class_words()
    complete = [total(F.col("complete")).alias("complete_pixels")] if "complete" in words.columns else []
    return words.groupBy(*keys).agg(
        *complete,
        total(F.col("present")).alias("total_pixels"),
        total(F.col("mask")).alias("changed_pixels"),
        total(classes["new_construction"]).alias("construction_pixels"),
        total(classes["vegetation_loss"]).alias("vegetation_pixels"),
        total(classes["surface_water"]).alias("water_pixels"),
    )


def count_mask(df: DataFrame, mask: str, keys: Sequence[str]) -> DataFrame:
    """Total and changed pixels of a 0/1 pixel column."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pixels"),
        F.count_if(F.col(mask) == 1).alias("changed_pixels"),
    )


def with_change(counts: DataFrame, digits: int = 2) -> DataFrame:
    """Add the changed percentage of the whole rectangle and the changed area."""
    return counts.withColumns(
        {
            "change_percentage": percent(F.col("changed_pixels"), F.col("total_pixels")),
            "changed_area_km2": area_km2(F.col("changed_pixels"), digits),
        }
    )


def with_class_areas(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "new_construction_km2": area_km2(F.col("construction_pixels")),
            "vegetation_loss_km2": area_km2(F.col("vegetation_pixels")),
            "surface_water_km2": area_km2(F.col("water_pixels")),
        }
    )


def metrics_document(metrics: DataFrame, base_uri: str) -> DataFrame:
    """Nested document per request: metrics, a classification struct and artifact URIs."""
    uris = artifact_uris(F.col("aoi_id"), F.col("date1"), F.col("date2"), base_uri)
    return metrics.select(
        *[c for c in ("request_id",) if c in metrics.columns],
        "aoi_id",
        "date1",
        "date2",
        "total_pixels",
        "changed_pixels",
        "change_percentage",
        "changed_area_km2",
        F.struct("new_construction_km2", "vegetation_loss_km2", "surface_water_km2").alias(
            "classification"
        ),
        *[uri.alias(name) for name, uri in uris.items()],
    )


def result_summary(documents: DataFrame) -> DataFrame:
    """Text view of documents: upper-cased AOI, missing class areas as N/A."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(f"classification.{name}").cast("string"), F.lit("N/A")).alias(name)

    return documents.select(
        *[c for c in ("request_id",) if c in documents.columns],
        F.upper("aoi_id").alias("title"),
        F.col("change_percentage").cast("string").alias("change_percentage"),
        F.col("changed_area_km2").cast("string").alias("changed_area_km2"),
        shown("new_construction_km2"),
        shown("vegetation_loss_km2"),
        shown("surface_water_km2"),
    )
