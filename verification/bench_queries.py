"""Queries timed by bench.py: headline operators, and cleaning and counting on 16x the pixels."""

from __future__ import annotations

from terradelta.operators import bands, bitrows, metrics, morphology
from verification import fixtures as fx
from verification.queries import QUERIES


def clean_counts_16x(spark, sf):
    steps = morphology.cleaning(3)
    halo = morphology.halo_of(steps)
    words = bitrows.pack(fx.bench_pixels(spark, sf), ["aoi_id"], bands.change_flags(), halo)
    words = morphology.transform_words(words, ["aoi_id"], ["mask"], steps, ["vegetation", "water"])
    return metrics.count_words(words, ["aoi_id"])


HEADLINE = (
    "stack_bands",
    "natural_rgb",
    "classify_pixels",
    "clip_to_aoi",
    "pair_dates",
    "morph_clean",
    "change_overlay",
    "change_metrics",
    "even_sample",
    "mask_points",
    "from_utm",
    "resize_bilinear",
    "select_scene",
    "footprint_intersects",
    "detect_changes",
    "detect_changes_legacy",
    "plan_scenes",
)

BENCH = {**{name: QUERIES[name] for name in HEADLINE}, "clean_counts_16x": clean_counts_16x}
