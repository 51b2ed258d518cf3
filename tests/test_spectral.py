import numpy as np
from pyspark.sql import functions as F

from terradelta.functions import spectral as sp
from terradelta.functions.numbers import area_km2, floor_div, percent


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_brightness_matches_single_precision_rule(spark):
    dn = np.arange(-5, 3001)
    want = (np.clip(dn.astype(np.float32) / 2500.0, 0, 1) * 255).astype(np.uint8)
    got = [r[0] for r in spark.range(-5, 3001).coalesce(1).select(sp.brightness(F.col("id"))).collect()]
    assert got == want.tolist()


def test_indices_are_single_precision_and_zero_when_undefined(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6000, 500), rng.integers(0, 6000, 500)
    a[:5] = b[:5] = 0
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    want = np.divide(fa - fb, fa + fb, out=np.zeros_like(fa), where=fa + fb != 0)
    got = values(
        spark,
        sp.normalized_difference(F.col("a"), F.col("b")),
        list(zip(a.tolist(), b.tolist())),
        "a int, b int",
    )
    assert np.array_equal(np.array(got, dtype=np.float32), want)


def test_index_threshold_is_strict_in_single_precision(spark):
    at = float(np.float32(0.15))
    above = float(np.nextafter(np.float32(0.15), np.float32(1)))
    rows = [(at,), (above,), (-at,), (-above,)]
    assert values(spark, sp.lost_vegetation(F.col("d")), rows, "d float") == [False, True, False, False]
    assert values(spark, sp.moved_water(F.col("d")), rows, "d float") == [False, True, False, True]


def test_mean_difference_threshold(spark):
    rows = [(25, 25, 25), (25, 25, 26), (0, 0, 75), (0, 0, 76)]
    zero = [F.lit(0)] * 3
    channels = [F.col(c) for c in "abc"]
    got = values(spark, sp.rgb_changed(zero, channels), rows, "a int, b int, c int")
    assert got == [False, True, False, True]
    mean = sp.threshold(sp.rgb_difference(zero, channels), 25)
    assert values(spark, mean, rows, "a int, b int, c int") == [0, 1, 0, 1]


def test_grayscale_of_grays_is_identity(spark):
    rows = [(v, v, v) for v in range(256)]
    got = values(spark, sp.grayscale(*[F.col(c) for c in "abc"]), rows, "a int, b int, c int")
    assert got == list(range(256))


def test_classes_overlap_and_construction_is_the_rest(spark):
    rows = [(c, v, w) for c in (True, False) for v in (True, False) for w in (True, False)]
    df = spark.createDataFrame(rows, "c boolean, v boolean, w boolean")
    got = df.select("c", "v", "w", *sp.class_flags(F.col("c"), F.col("v"), F.col("w"))).collect()
    for c, v, w, veg, water, built in got:
        assert (veg, water, built) == (c and v, c and w, c and not v and not w)


def test_rounding_is_half_up(spark):
    rows = [(n,) for n in (0, 49, 50, 149, 150, 250)]
    assert values(spark, area_km2(F.col("n")), rows, "n bigint") == [0.0, 0.0, 0.01, 0.01, 0.02, 0.03]
    assert values(spark, area_km2(F.col("n"), 4), rows, "n bigint")[1] == 0.0049
    rows = [(0, 10), (1, 3), (2, 3), (1, 8), (10, 10), (0, 0)]
    got = values(spark, percent(F.col("n"), F.col("t")), rows, "n bigint, t bigint")
    assert got == [0.0, 33.33, 66.67, 12.5, 100.0, None]


def test_floor_div_rounds_down(spark):
    rows = [(v,) for v in (-57, -56, -1, 0, 55, 56)]
    assert values(spark, floor_div(F.col("v"), 56), rows, "v bigint") == [-2, -1, -1, 0, 0, 1]
