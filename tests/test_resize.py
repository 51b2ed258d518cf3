import numpy as np
import pytest

from terradelta.operators.resize import resize_bilinear
from tests import helpers as h


def brute(image, rows, cols):
    """Centre-aligned bilinear resampling, rounded half up."""
    sh, sw = image.shape
    fy = np.clip((np.arange(rows) + 0.5) * sh / rows - 0.5, 0, sh - 1)
    fx = np.clip((np.arange(cols) + 0.5) * sw / cols - 0.5, 0, sw - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, sh - 1), np.minimum(x0 + 1, sw - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    top = image[np.ix_(y0, x0)] * (1 - wx) + image[np.ix_(y0, x1)] * wx
    low = image[np.ix_(y1, x0)] * (1 - wx) + image[np.ix_(y1, x1)] * wx
    return np.floor(np.round(top * (1 - wy) + low * wy, 7) + 0.5).astype(int)


@pytest.mark.parametrize("target", [(5, 7), (10, 14), (13, 9), (2, 3), (1, 1), (5, 20)])
def test_matches_brute_force(spark, target):
    image = np.random.default_rng(4).integers(0, 256, (5, 7))
    df = h.raster(spark, {"a": image}, "v")
    sizes = spark.createDataFrame(
        [("a", 7, 5, target[1], target[0])],
        "aoi_id string, src_width bigint, src_height bigint, dst_width bigint, dst_height bigint",
    )
    got = h.grid(resize_bilinear(df, sizes, ["v"]), target, "v")
    assert np.array_equal(got, brute(image, *target))
