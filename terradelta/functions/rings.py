"""Polygon rings as array columns.

A lon/lat ring is ``array<array<double>>`` of ``[lon, lat]`` pairs; a planar ring is
``array<struct<x double, y double>>``. Rings are closed: the last point repeats the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta.functions.projection import is_supported, to_crs


def closed(ring: Column) -> Column:
    """The ring as [lon, lat] pairs without further coordinates, its first point repeated at the end."""
    flat = F.transform(ring, lambda p: F.slice(p, 1, 2))
    shut = F.element_at(flat, 1) == F.element_at(flat, -1)
    return F.when(F.size(flat) == 0, flat).when(shut, flat).otherwise(F.concat(flat, F.slice(flat, 1, 1)))


def normalize_ring(df: DataFrame, column: str) -> DataFrame:
    """Close a ring; a list of rings (GeoJSON style: border, then holes) becomes one ring.

    Rings after the first are reached from the first point and left to it again. Such a cut runs there and
    back along the same line, so it flips nothing under the even-odd rule, and holes stay holes.
    """
    kind = df.schema[column].dataType
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if depth < 3:
        return df.withColumn(column, closed(F.col(column)))
    rings = F.filter(F.transform(column, closed), lambda r: F.size(r) > 0)
    start = F.slice(F.element_at(rings, 1), 1, 1)
    joined = F.flatten(F.transform(rings, lambda r, i: F.when(i == 0, r).otherwise(F.concat(r, start))))
    return df.withColumn(column, F.when(F.size(rings) > 0, joined).when(F.col(column).isNotNull(), F.array().cast("array<array<double>>")))


def is_polygon(ring: Column) -> Column:
    """At least three different points, all with two finite coordinates."""
    whole = F.forall(
        ring, lambda p: p.isNotNull() & (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 360))
    )
    return whole & (F.size(F.array_distinct(ring)) >= 3)


def swap_axes(ring: Column) -> Column:
    """[lon, lat] pairs to [lat, lon] pairs, or back."""
    return F.transform(ring, lambda p: F.array(p[1], p[0]))


def planar(ring: Column) -> Column:
    """[x, y] pairs to a planar ring, without projecting."""
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def unwrapped(ring: Column) -> Column:
    """A lon/lat ring that crosses the 180th meridian with its western longitudes counted on beyond 180.

    A ring crosses it if an edge jumps by more than 180 degrees; all others stay as they are.
    """
    jumps = F.zip_with(ring, F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.abs(p[0] - q[0]) > 180.0)
    east = F.transform(ring, lambda p: F.array(F.when(p[0] < 0, p[0] + 360.0).otherwise(p[0]), p[1]))
    return F.when(F.exists(jumps, lambda j: j), east).otherwise(ring)


def ring_key(ring: Column) -> Column:
    """128 bits that stand for a ring, to group and join on instead of on nested arrays."""
    return F.struct(
        F.xxhash64(F.lit(1), ring).alias("high"), F.xxhash64(F.lit(2), ring).alias("low")
    )


def ring_to_wkt(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ", "), F.lit("))"))


def ring_to_crs(ring: Column, epsg: Column) -> Column:
    """A lon/lat ring projected vertex by vertex to a planar ring in the raster's CRS; null where that is not supported."""

    def project(p: Column) -> Column:
        x, y = to_crs(p[0], p[1], epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(is_supported(epsg), F.transform(ring, project))


ring_to_utm = ring_to_crs  # for callers that know their rasters to be in UTM


def ring_to_pixels(ring: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    """A planar ring in metres to fractional (col, row) coordinates of a raster."""
    return F.transform(
        ring,
        lambda p: F.struct(((p["x"] - x0) / px).alias("x"), ((y0 - p["y"]) / py).alias("y")),
    )


def bounds(ring: Column) -> list[Column]:
    """min x, min y, max x, max y of a planar ring."""
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed planar ring, as structs x1, y1, x2, y2."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), n - 1),
        F.slice(ring, F.lit(2), n - 1),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def contains(ring_edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against ring edges (half-open in y, so no vertex counts twice)."""

    def toggle(inside: Column, e: Column) -> Column:
        crosses = (e["y1"] > y) != (e["y2"] > y)
        rise = F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]).otherwise(F.lit(1.0))
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / rise + e["x1"]
        return inside != (crosses & (x < at))

    return F.aggregate(ring_edges, F.lit(False), toggle)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for a predicate, with ``value`` evaluated once."""
    return F.exists(F.array(value), use)


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Sign of the turn p -> q -> r."""
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _on_segment(e: Column, x: Column, y: Column) -> Column:
    """A point known to be collinear with ``e`` lies between its ends."""
    return (
        (x >= F.least(e["x1"], e["x2"]))
        & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"]))
        & (y <= F.greatest(e["y1"], e["y2"]))
    )


def _edges_meet(e: Column, f: Column) -> Column:
    sides = F.struct(
        _side(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"]).alias("f1"),
        _side(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"]).alias("f2"),
        _side(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"]).alias("e1"),
        _side(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"]).alias("e2"),
    )

    def decide(s: Column) -> Column:
        return (
            ((s["f1"] != s["f2"]) & (s["e1"] != s["e2"]))
            | ((s["f1"] == 0) & _on_segment(e, f["x1"], f["y1"]))
            | ((s["f2"] == 0) & _on_segment(e, f["x2"], f["y2"]))
            | ((s["e1"] == 0) & _on_segment(f, e["x1"], e["y1"]))
            | ((s["e2"] == 0) & _on_segment(f, e["x2"], e["y2"]))
        )

    return _let(sides, decide)


def with_shape(df: DataFrame, ring: Column, prefix: str) -> DataFrame:
    """Add what :func:`shapes_meet` needs of a planar ring: bounds, edges and whether it is a box.

    Runs once per polygon, before any join, so that nothing of it is recomputed per pair.
    """
    flat = F.col(f"{prefix}ring")
    names = [f"{prefix}{n}" for n in ("x1", "y1", "x2", "y2")]
    # one projection for the ring: six expressions read it
    shaped = df.withColumn(f"{prefix}ring", ring).withColumns(
        {**dict(zip(names, bounds(flat))), f"{prefix}edges": edges(flat)}
    )
    return shaped.withColumn(f"{prefix}box", is_box(F.col(f"{prefix}edges"))).drop(f"{prefix}ring")


def is_box(ring_edges: Column) -> Column:
    """Four axis-parallel edges: bounds decide every question about such a ring."""
    return (F.size(ring_edges) == 4) & F.forall(
        ring_edges, lambda e: (e["x1"] == e["x2"]) | (e["y1"] == e["y2"])
    )


def box_of(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2")]


def bounds_overlap(a: list[Column], b: list[Column]) -> Column:
    """Closed bounding boxes share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def _edges_near(ring_edges: Column, box: list[Column]) -> Column:
    """Edges whose own bounds touch a box."""

    def near(e: Column) -> Column:
        low = [F.least(e["x1"], e["x2"]), F.least(e["y1"], e["y2"])]
        high = [F.greatest(e["x1"], e["x2"]), F.greatest(e["y1"], e["y2"])]
        return bounds_overlap([*low, *high], box)

    return F.filter(ring_edges, near)


def _edges_of_box(box: list[Column]) -> Column:
    x1, y1, x2, y2 = box
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    return F.array(
        *[
            F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
            for (a, b), (c, d) in zip(corners, corners[1:])
        ]
    )


def _share_point(ea: Column, box_a: list[Column], eb: Column, box_b: list[Column]) -> Column:
    """One polygon holds a vertex of the other, or an edge pair meets.

    Only edges near the other polygon are tried.
    """
    first_a, first_b = F.element_at(ea, 1), F.element_at(eb, 1)
    near = F.struct(_edges_near(ea, box_b).alias("a"), _edges_near(eb, box_a).alias("b"))
    return (
        contains(eb, first_a["x1"], first_a["y1"])
        | contains(ea, first_b["x1"], first_b["y1"])
        | _let(
            near,
            lambda n: F.exists(n["a"], lambda e: F.exists(n["b"], lambda f: _edges_meet(e, f))),
        )
    )


def shapes_meet(a: str, b: str) -> Column:
    """Two closed polygons, added as prefixes by :func:`with_shape`, share a point.

    Bounds first; they settle two boxes.
    """
    exact = _share_point(F.col(f"{a}edges"), box_of(a), F.col(f"{b}edges"), box_of(b))
    boxes = F.col(f"{a}box") & F.col(f"{b}box")
    return bounds_overlap(box_of(a), box_of(b)) & (boxes | exact)


def turned(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with shape ``b`` turned by whole circles of longitude to where it is nearest to shape ``a``."""
    apart = F.col(f"{a}x1") + F.col(f"{a}x2") - F.col(f"{b}x1") - F.col(f"{b}x2")
    by = F.round(apart / 720.0) * 360.0
    turn = F.col(f"{b}turn")

    def shifted(e: Column) -> Column:
        return F.struct((e["x1"] + turn).alias("x1"), e["y1"].alias("y1"), (e["x2"] + turn).alias("x2"), e["y2"].alias("y2"))

    same = F.col(f"{b}edges")
    moved = F.when(turn == 0, same).otherwise(F.transform(same, shifted))
    return (
        df.withColumn(f"{b}turn", by)
        .withColumns({f"{b}x1": F.col(f"{b}x1") + turn, f"{b}x2": F.col(f"{b}x2") + turn, f"{b}edges": moved})
        .drop(f"{b}turn")
    )


def shape_meets_box(a: str, box: list[Column]) -> Column:
    """A closed polygon and an axis-parallel box share a point."""
    exact = _share_point(F.col(f"{a}edges"), box_of(a), _edges_of_box(box), box)
    return bounds_overlap(box_of(a), box) & (F.col(f"{a}box") | exact)


def shape_covers_box(a: str, box: list[Column]) -> Column:
    """A polygon holds all of a box, with nothing of its boundary on it (unless it is a box too)."""
    x1, y1, x2, y2 = box_of(a)
    within = (x1 <= box[0]) & (y1 <= box[1]) & (x2 >= box[2]) & (y2 >= box[3])
    edges_a = F.col(f"{a}edges")
    apart = ~F.exists(
        _edges_near(edges_a, box), lambda e: F.exists(_edges_of_box(box), lambda f: _edges_meet(e, f))
    )
    return within & (F.col(f"{a}box") | (contains(edges_a, box[0], box[1]) & apart))
