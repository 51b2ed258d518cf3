"""Artifact names and URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _join(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def artifact_names(aoi: Column, date1: Column, date2: Column) -> dict[str, Column]:
    """File names of a request's artifacts."""
    # fixed values: name patterns
    return {
        "raw_image": _join("rgb_date1_", aoi, "_", date1, ".png"),
        "processed_image": _join("rgb_date2_", aoi, "_", date2, ".png"),
        "clean_map": _join("change_overlay_", aoi, "_", date2, ".png"),
        "comparison": _join("comparison_", aoi, "_", date2, ".png"),
        "map": _join("interactive_map_", aoi, "_", date2, ".html"),
    }


def artifact_uris(aoi: Column, date1: Column, date2: Column, base: str) -> dict[str, Column]:
    """Artifact names under ``<base>/processed/<aoi>/`` as ``<kind>_url`` columns."""
    names = artifact_names(aoi, date1, date2)
    return {f"{k}_url": _join(f"{base}/processed/", aoi, "/", name) for k, name in names.items()}


def place_slug(place: Column) -> Column:
    return F.replace(F.lower(place), F.lit(" "), F.lit("_"))


def legacy_artifact_names(place: Column, day: Column) -> dict[str, Column]:
    """File names of the two-image path: kind, place, date and year."""
    stem = _join(place_slug(place), "_", day, "_", F.split_part(day, F.lit("-"), F.lit(1)), ".png")
    # fixed values: kinds
    kinds = {
        "raw": "raw",
        "processed": "processed",
        "clean_map": "clean_change_map",
        "comparison": "comparison",
    }
    return {k: _join(f"{kind}_", stem) for k, kind in kinds.items()}


def resolve_uri(uri: Column, base: str) -> Column:
    """Prefix ``base`` to a path that starts with a slash; other values and NULL pass through."""
    return F.when(F.startswith(uri, F.lit("/")), F.concat(F.lit(base), uri)).otherwise(uri)
