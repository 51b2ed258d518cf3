import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.operators import bitrows, sampling
from tests import helpers as h


@pytest.mark.parametrize("k", [1, 2, 7, 200])
def test_even_sample_matches_linspace(spark, k):
    sizes = [1, 2, 5, 7, 8, 9, 100, 199, 200, 201, 202, 399, 1000, 2500]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    ranks = df.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    kept = ranks.where(sampling.sampled(F.col("rank"), F.col("n"), k)).collect()
    for n in sizes:
        want = range(n) if n <= k else np.linspace(0, n - 1, k, dtype=int).tolist()
        assert sorted(r.rank for r in kept if r.n == n) == list(want)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_words_kept_are_those_that_hold_a_sample(spark, k):
    rows = [(n, s, min(13, n - s)) for n in (5, 50, 201, 977) for s in range(0, n, 13)]
    df = spark.createDataFrame(rows, "n bigint, start bigint, hits bigint")
    held = df.withColumn("held", sampling.holds_sample(*[F.col(c) for c in ("start", "hits", "n")], k))
    for r in held.collect():
        picks = range(r.n) if r.n <= k else np.linspace(0, r.n - 1, k, dtype=int)
        assert r.held == any(r.start <= p < r.start + r.hits for p in picks), r


def test_ranks_are_row_major_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(bitrows, "TILE_ROWS", 8)
    rng = np.random.default_rng(2)
    masks = {"a": (rng.random((30, 140)) < 0.4).astype(int), "b": np.eye(20, dtype=int)}
    words = bitrows.pack(h.raster(spark, masks), ["aoi_id"], {"bits": F.col("mask") == 1}, 4)
    words = words.where("bits != 0")
    ranked = sampling.rank_words(words, ["aoi_id"])
    got = sampling.rank_pixels(ranked, ["aoi_id"], 4).collect()
    for aoi, mask in masks.items():
        want = list(zip(*np.where(mask)))
        rows = sorted((r["rank"], r.row, r.col) for r in got if r.aoi_id == aoi)
        assert [(r, c) for _, r, c in rows] == want
        assert [k for k, _, _ in rows] == list(range(len(want)))
    picked = sampling.even_sample(ranked, ["aoi_id"], 4, 7).collect()
    n = int(masks["a"].sum())
    assert sorted(r["rank"] for r in picked if r.aoi_id == "a") == np.linspace(0, n - 1, 7, dtype=int).tolist()
