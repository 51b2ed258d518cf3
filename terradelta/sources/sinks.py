"""Sinks for documents and features."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_metrics(documents: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """One nested document per request, as JSON lines or Parquet."""
    documents.write.mode(mode).format(fmt).save(path)


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """GeoJSON features as text lines, one folder per layer; each names its request in its properties."""
    features.select("layer", "feature").write.mode(mode).partitionBy("layer").text(path)
