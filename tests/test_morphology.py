import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.operators import bitrows, morphology
from tests import helpers as h

OPERATORS = {
    "erode": (morphology.erode, h.erode),
    "dilate": (morphology.dilate, h.dilate),
    "open": (morphology.morph_open, h.opened),
    "close": (morphology.morph_close, h.closed),
    "clean": (morphology.morph_clean, h.cleaned),
}


def hand_made() -> dict[str, np.ndarray]:
    def blank():
        return np.zeros((9, 9), dtype=int)

    single, block, hole, line, corner = blank(), blank(), blank(), blank(), blank()
    single[4, 4] = 1
    block[3:6, 3:6] = 1
    hole[2:7, 2:7] = 1
    hole[4, 4] = 0
    line[4, :] = 1
    corner[:3, :3] = 1
    return {
        "single": single, "block": block, "hole": hole, "line": line, "corner": corner,
        "empty": blank(), "full": blank() + 1,
    }


@pytest.mark.parametrize("name", OPERATORS)
def test_hand_made_rasters_side_by_side(spark, name):
    masks = hand_made()
    run, brute = OPERATORS[name]
    got = run(h.raster(spark, masks), "mask", 3).cache()
    for aoi, mask in masks.items():
        assert np.array_equal(h.grid(got, mask.shape, aoi=aoi), brute(mask, 3)), aoi


@pytest.mark.parametrize("n", [3, 5, 7])
@pytest.mark.parametrize("name", OPERATORS)
def test_random_rasters_across_word_and_tile_borders(spark, monkeypatch, name, n):
    monkeypatch.setattr(bitrows, "TILE_ROWS", 16)
    rng = np.random.default_rng(n)
    shape = (37, 131)
    mask = (rng.random(shape) < 0.75).astype(int)
    run, brute = OPERATORS[name]
    got = run(h.raster(spark, {"a": mask}), "mask", n)
    assert np.array_equal(h.grid(got, shape), brute(mask, n))


def test_radius_beyond_one_halo(spark):
    rng = np.random.default_rng(5)
    mask = (rng.random((45, 90)) < 0.998).astype(int)
    got = morphology.erode(h.raster(spark, {"a": mask}), "mask", 37)
    assert np.array_equal(h.grid(got, mask.shape), h.erode(mask, 37))
    got = morphology.morph_open(h.raster(spark, {"a": mask}), "mask", 25)
    assert np.array_equal(h.grid(got, mask.shape), h.opened(mask, 25))


def test_even_sizes_are_rejected():
    with pytest.raises(ValueError):
        morphology.erosion(4)


def test_properties(spark):
    rng = np.random.default_rng(9)
    mask = (rng.random((30, 70)) < 0.6).astype(int)
    df = h.raster(spark, {"a": mask})
    opened = morphology.morph_open(df, "mask")
    closed = morphology.morph_close(df, "mask")
    o, c = h.grid(opened, mask.shape), h.grid(closed, mask.shape)
    assert (o <= mask).all() and (mask <= c).all()
    assert np.array_equal(h.grid(morphology.morph_open(opened, "mask"), mask.shape), o)
    assert np.array_equal(h.grid(morphology.morph_close(closed, "mask"), mask.shape), c)


def test_offset_rasters_keep_their_coordinates(spark):
    mask = np.ones((4, 5), dtype=int)
    df = h.raster(spark, {"a": mask}).withColumns(
        {"row": F.col("row") + 510, "col": F.col("col") - 3}
    )
    got = {(r.row, r.col, r.mask) for r in morphology.morph_clean(df, "mask").collect()}
    assert got == {(r, c, 1) for r in range(510, 514) for c in range(-3, 2)}


def test_pack_unpack_and_attach(spark):
    rng = np.random.default_rng(3)
    mask = (rng.random((6, 150)) < 0.5).astype(int)
    df = h.raster(spark, {"a": mask})
    words = bitrows.pack(df, ["aoi_id"], {"mask": F.col("mask") == 1}, 4)
    assert words.count() == 6 * 3
    assert np.array_equal(h.grid(bitrows.unpack(words, ["aoi_id"], ["mask"], 4), mask.shape), mask)
    seen = bitrows.attach(df.drop("mask"), words, ["aoi_id"], ["mask"], 4)
    assert np.array_equal(h.grid(seen, mask.shape), mask)
