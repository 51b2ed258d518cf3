from datetime import date, datetime, timedelta

import pytest

from terradelta.operators import scenes
from terradelta.plans.scene_plan import plan_scenes
from terradelta.schemas import CATALOG

DAY = date(2024, 6, 15)
REQUESTS = "aoi_id string, target_date date, coords array<array<double>>"


def box(x, y, side):
    x, y, side = float(x), float(y), float(side)
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


def product(i, days, cloud, ring, kind="S2MSI2A", hour=12):
    when = datetime(DAY.year, DAY.month, DAY.day, hour) + timedelta(days=days)
    return (i, when, kind, cloud, ring)


def found(spark, requests, products, **options):
    got = scenes.top_scenes(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(products, CATALOG), **options
    )
    return sorted((r.aoi_id, r["rank"], r.product_id) for r in got.collect())


def test_window_type_and_order(spark):
    here, away = box(0.2, 0.2, 0.5), box(5, 5, 1)
    products = [
        product(1, -5, 30.0, here, hour=0),
        product(2, 5, 20.0, here, hour=23),
        product(3, -6, 0.0, here, hour=23),
        product(4, 6, 0.0, here, hour=0),
        product(5, 0, 20.0, here),
        product(6, 0, 0.0, away),
        product(7, 0, 0.0, here, kind="S2MSI1C"),
    ]
    requests = [("q", DAY, box(0.4, 0.4, 0.1)), ("none", DAY, box(20, 20, 1))]
    assert found(spark, requests, products) == [("q", 1, 2), ("q", 2, 5), ("q", 3, 1)]


def test_only_the_clearest_five_and_copies(spark):
    """More than five candidates; copies of one footprint on one day, equal requests."""
    products = [product(i, i % 3, float(90 - i), box(0, 0, 2)) for i in range(40)]
    products += [product(100 + i, 1, 60.0, box(0.5, 0.5, 3)) for i in range(10)]
    requests = [(f"q{i}", DAY, box(1, 1, 0.5)) for i in range(3)]
    want = [39, 38, 37, 36, 35]
    assert found(spark, requests, products) == [
        (f"q{i}", rank, p) for i in range(3) for rank, p in enumerate(want, 1)
    ]


def test_pair_sharing_many_cells_appears_once(spark):
    got = found(spark, [("q", DAY, box(-3.3, -2.1, 6))], [product(1, 0, 5.0, box(-9, -9, 20))], cell=0.5)
    assert got == [("q", 1, 1)]


def test_crowded_cell_is_cut_before_the_join(spark):
    """Distinct footprints over one cell: only the clearest k and partial covers reach the join."""
    over = [product(i, 0, float(i), box(-1 - i / 1000, -1, 4)) for i in range(200)]
    part = [product(500 + i, 0, 99.0, box(0.1 + i / 1000, 0.1, 0.2)) for i in range(7)]
    catalog = spark.createDataFrame(over + part, CATALOG)
    kept = scenes.offered_cells(catalog, 1.0, 5).where("cell_x = 0 and cell_y = 0")
    assert sorted(r.product_id for r in kept.collect()) == [0, 1, 2, 3, 4, *range(500, 507)]
    assert found(spark, [("q", DAY, box(0.5, 0.5, 0.1))], over + part) == [("q", i + 1, i) for i in range(5)]


def test_slanted_request_and_slanted_covers(spark):
    """A triangle whose bounds touch cells it does not: covers of those cells must not hide others."""
    triangle = [[0.0, 0.0], [2.9, 0.0], [0.0, 2.9], [0.0, 0.0]]
    decoys = [product(i, 0, 1.0, box(2, 2, 1)) for i in range(10)]
    diamond = [[1.5, -6.0], [9.0, 1.5], [1.5, 9.0], [-6.0, 1.5], [1.5, -6.0]]
    products = [*decoys, product(50, 0, 8.0, diamond), product(51, 0, 9.0, box(0.2, 0.2, 0.1))]
    got = found(spark, [("q", DAY, triangle)], products, cell=1.0)
    assert got == [("q", 1, 50), ("q", 2, 51)]


def test_shapes_are_tested_exactly(spark):
    triangle = [[0.0, 0.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]]
    products = [product(1, 0, 5.0, triangle)]
    requests = [("far", DAY, box(3, 3, 0.9)), ("near", DAY, box(1.9, 1.9, 1))]
    assert found(spark, requests, products) == [("near", 1, 1)]


@pytest.mark.parametrize("cell", [0.3, 1.0, 4.0])
def test_same_as_comparing_every_pair(spark, cell):
    import random

    rng = random.Random(8)
    products = [
        product(i, rng.randint(-9, 9), rng.randint(0, 20) * 5.0, box(rng.random() * 6, rng.random() * 6, 1 + rng.random()))
        for i in range(120)
    ]
    requests = [
        (f"q{i}", DAY + timedelta(days=rng.randint(-3, 3)), box(rng.random() * 6, rng.random() * 6, 0.4))
        for i in range(40)
    ]
    want = []
    for name, day, a in requests:
        hits = []
        for i, when, _, cloud, b in products:
            near = abs((when.date() - day).days) <= 5
            meet = a[0][0] <= b[2][0] and b[0][0] <= a[2][0] and a[0][1] <= b[2][1] and b[0][1] <= a[2][1]
            if near and meet:
                hits.append((cloud, i))
        want += [(name, r, i) for r, (_, i) in enumerate(sorted(hits)[:5], 1)]
    assert found(spark, requests, products, cell=cell) == sorted(want)


def test_plan_fetches_each_missing_asset_once(spark):
    products = [product(1, 0, 5.0, box(0, 0, 2)), product(2, 0, 9.0, box(4, 4, 2))]
    requests = [("a", DAY, box(1, 1, 0.5)), ("b", DAY, box(1.2, 1, 0.5)), ("c", DAY, box(9, 9, 0.1))]
    stems = [(i, f"s{i}/", f"g{i}/", f"p{i}") for i in (1, 2)]
    plan = plan_scenes(
        spark.createDataFrame(requests, REQUESTS),
        spark.createDataFrame(products, CATALOG),
        spark.createDataFrame(stems, "product_id bigint, scene string, granule string, prefix string"),
        spark.createDataFrame([("s1/g1/p1_B03_10m.jp2",)], "asset_key string"),
    )
    keys = sorted(r.asset_key for r in plan.to_fetch.collect())
    assert keys == [f"s1/g1/p1_{b}_10m.jp2" for b in ("B02", "B04", "B08")]
    assert [r.aoi_id for r in plan.unmatched.collect()] == ["c"]
