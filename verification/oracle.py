"""SQL for each registered query, written independently of the library.

Morphology is the plain chain of separable windows on pixels, scene search a direct spatial-interval
join, sampling a row_number over all pixels: the simple forms the library avoids at scale.
"""

from __future__ import annotations

import re

from terradelta.functions import utm
from terradelta.sources.aoi_library import DEFAULT_DATES, RINGS
from verification.fixtures import AFTER, BANDS, BEFORE, DATE1, DATE2, QUAD

ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> str:
    CTES[name] = sql
    return name


def _names_in(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def register(name: str, sql: str) -> None:
    """Prefix ``sql`` with the CTEs it needs, in order of definition."""
    needed: set[str] = set()
    todo = _names_in(sql)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in _names_in(CTES[n]) if m != n]
    order = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    ORACLE[name] = ("WITH " + ", ".join(order) + " " if order else "") + sql


# --- fixtures --------------------------------------------------------------------------------------


def _pixel_values() -> str:
    out = []
    for i, band in enumerate(BANDS):
        cases = " ".join(
            f"WHEN {cond} THEN {AFTER[kind][i]}"
            for cond, kind in [
                ("k = 0", "construction"),
                ("k = 1", "vegetation_water"),
                ("k = 2", "water"),
                ("k = 3", "vegetation"),
                ("salt", "salt"),
            ]
        )
        out.append(f"CAST(CASE WHEN k = -1 THEN 0 ELSE nz + {BEFORE[i]} END AS INTEGER) AS {band}_1")
        out.append(
            f"CAST(CASE WHEN k = -1 THEN 0 ELSE nz + CASE {cases} ELSE {BEFORE[i]} END END AS INTEGER)"
            f" AS {band}_2"
        )
    return ", ".join(out)


cte(
    "ev",
    """SELECT event_id // 100 AS r, event_id % 100 AS col,
       CASE WHEN event_id // 100 < 5 THEN -1 WHEN user_id % 29 = 0 THEN 9
            ELSE (event_id // 100 // 10 + 3 * (event_id % 100 // 10)) % 7 END AS k,
       CAST(floor(value * 100) AS BIGINT) % 120 AS nz, user_id % 11 = 0 AS salt
       FROM events""",
)
cte("px", f"SELECT 'site' || (r // 25) AS aoi_id, r % 25 AS row, col, {_pixel_values()} FROM ev")
cte(
    "dated",
    " UNION ALL ".join(
        f"SELECT aoi_id, '{d}' AS scene_date, row, col, "
        + ", ".join(f"{b}_{i} AS {b}" for b in BANDS)
        + " FROM px"
        for i, d in ((1, DATE1), (2, DATE2))
    ),
)
cte(
    "long_bands",
    " UNION ALL ".join(
        f"SELECT aoi_id, scene_date, '{b.upper()}' AS band, row, col, {b} AS dn FROM dated" for b in BANDS
    ),
)
cte(
    "meta",
    """SELECT 'site' || (r // 25) AS aoi_id, CAST(r // 25 AS BIGINT) AS site, 379290.0::DOUBLE AS x0,
       CAST(2050820 - 250 * (r // 25) AS DOUBLE) AS y0, 10.0::DOUBLE AS px_size,
       100::BIGINT AS width, max(r % 25) + 1 AS height
       FROM (SELECT event_id // 100 AS r FROM events) GROUP BY r // 25""",
)


def lonlat(corners: list[tuple[str, str]], site: str) -> str:
    pts = [
        f"[({c} * 95 + 73856313) / 1e6::DOUBLE, (18544483 - {site} * 2259 - {r} * 90) / 1e6::DOUBLE]"
        for c, r in corners
    ]
    return "[" + ", ".join([*pts, pts[0]]) + "]"


_library = " UNION ALL ".join(
    f"SELECT '{name}' AS aoi_id, CAST({ring} AS DOUBLE[][]) AS coords" for name, ring in RINGS.items()
)
cte(
    "aois",
    f"""SELECT aoi_id, coords, '{DEFAULT_DATES[0]}' AS date1, '{DEFAULT_DATES[1]}' AS date2 FROM
        ({_library} UNION ALL
         SELECT aoi_id, {lonlat([(str(c), str(r)) for c, r in QUAD], 'site')} FROM meta)""",
)
_own = lonlat(
    [
        ("(v * 5 + 10)", "3"),
        ("(80 - v * 3)", "(v + 2)"),
        ("85", "20"),
        ("12", "(22 - v)"),
    ],
    "s",
)
cte(
    "reqs",
    f"""SELECT c AS request_id,
        CASE WHEN c % 13 = 0 THEN 'nowhere' || (c % 5) WHEN c % 17 = 1 THEN 'hinjewadi'
             ELSE 'site' || s END AS aoi_id,
        CASE WHEN c % 3 <> 0 THEN '{DATE1}' END AS date1,
        CASE WHEN c % 11 = 0 THEN '{DATE1}' WHEN c % 5 <> 0 THEN '{DATE2}' END AS date2,
        CASE WHEN c % 4 = 1 THEN {_own} END AS coords
        FROM (SELECT c_custkey AS c, c_custkey % 3 AS v, c_custkey % 40 AS s FROM customer)""",
)
cte(
    "resolved",
    """SELECT q.request_id, q.aoi_id, coalesce(q.coords, a.coords) AS coords,
       coalesce(q.date1, a.date1, '2024-02-28') AS date1,
       coalesce(q.date2, a.date2, '2026-04-03') AS date2
       FROM reqs q LEFT JOIN aois a USING (aoi_id) WHERE coalesce(q.coords, a.coords) IS NOT NULL""",
)
cte(
    "cat",
    """SELECT o_orderkey AS product_id, o_orderdate AS sensing_start,
       CASE WHEN o_orderstatus = 'F' THEN 'S2MSI2A' ELSE 'S2MSI1C' END AS product_type,
       (CAST(floor(o_totalprice) AS BIGINT) % 10001) / 100.0::DOUBLE AS cloud_cover,
       CAST(o_custkey % 10 AS DOUBLE) AS lon0, CAST(o_custkey // 10 % 10 AS DOUBLE) AS lat0
       FROM orders""",
)
cte(
    "scene",
    """SELECT o_orderkey AS product_id,
       'MSI/L2A/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderkey || '.SAFE/GRANULE/L2A_'
       || o_orderkey || '/IMG_DATA/R10m/T43QCA_' || strftime(o_orderdate, '%Y%m%d') AS stem
       FROM orders""",
)
cte(
    "assets",
    """SELECT product_id, b AS asset_band, stem || '_' || b || '.jp2' AS asset_key
       FROM scene, (VALUES ('B02_10m'), ('B03_10m'), ('B04_10m'), ('B08_10m')) v(b)""",
)
cte(
    "sreq",
    """SELECT c_custkey AS aoi_id, DATE '1996-01-01' + CAST(c_custkey % 700 AS INTEGER) AS target_date,
       c_nationkey % 10 + 0.4::DOUBLE AS x, c_custkey % 10 + 0.4::DOUBLE AS y FROM customer""",
)
cte(
    "found",
    """SELECT q.aoi_id, q.target_date, c.product_id, c.cloud_cover, c.sensing_start,
       row_number() OVER (PARTITION BY q.aoi_id ORDER BY c.cloud_cover, c.product_id) AS rank
       FROM sreq q JOIN cat c ON c.product_type = 'S2MSI2A'
        AND c.sensing_start >= q.target_date - 5 AND c.sensing_start < q.target_date + 6
        AND c.lon0 <= q.x + 0.2 AND q.x <= c.lon0 + 1 AND c.lat0 <= q.y + 0.2 AND q.y <= c.lat0 + 1""",
)


def shade(band: str) -> str:
    """Display value of a band, by the floating-point rule."""
    return f"CAST(floor(least(greatest({band}, 0), 2500) * 51 / 500.0) AS INTEGER)"


cte(
    "rgb",
    "SELECT *, "
    + ", ".join(
        f"{shade(f'{b}_{i}')} AS {c}{i}"
        for i in (1, 2)
        for b, c in (("b04", "red"), ("b03", "green"), ("b02", "blue"))
    )
    + " FROM px",
)


def gray(r: str, g: str, b: str) -> str:
    return f"CAST((9798 * {r} + 19235 * {g} + 3735 * {b} + 16384) // 32768 AS INTEGER)"


def nd(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} + {b} = 0 THEN 0::FLOAT"
        f" ELSE CAST(CAST({a} - {b} AS DOUBLE) / CAST({a} + {b} AS DOUBLE) AS FLOAT) END"
    )


def indexed(source: str) -> str:
    parts = [f"{nd(f'b08_{i}', f'b04_{i}')} AS ndvi_{i}, {nd(f'b03_{i}', f'b08_{i}')} AS ndwi_{i}" for i in (1, 2)]
    return f"SELECT *, {', '.join(parts)} FROM {source}"


cte("idx", indexed("rgb"))


def flagged(source: str) -> str:
    return f"""SELECT *, abs(red1 - red2) + abs(green1 - green2) + abs(blue1 - blue2) AS total_difference,
        CAST(abs(red1 - red2) + abs(green1 - green2) + abs(blue1 - blue2) > 75 AS INTEGER) AS mask,
        CAST(ndvi_1 - ndvi_2 AS FLOAT) > 0.15::FLOAT AS veg,
        abs(CAST(ndwi_2 - ndwi_1 AS FLOAT)) > 0.15::FLOAT AS wat FROM {source}"""


cte("flags", flagged("idx"))


def chain(source: str, column: str, steps: list[tuple[str, int]], keys: str, prefix: str) -> str:
    """Separable min/max windows over pixels, two passes per step; returns the last CTE's name."""
    for i, (fn, h) in enumerate(steps):
        for axis, along, across in (("h", "col", "row"), ("v", "row", "col")):
            source = cte(
                f"{prefix}_{i}{axis}",
                f"""SELECT * REPLACE ({fn}({column}) OVER (PARTITION BY {keys}, {across} ORDER BY {along}
                    RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS {column}) FROM {source}""",
            )
    return source


OPEN3 = [("min", 1), ("max", 1)]
CLOSE3 = [("max", 1), ("min", 1)]
OPEN5 = [("min", 2), ("max", 2)]
clean = chain("flags", "mask", OPEN3 + CLOSE3, "aoi_id", "cl")
cte(
    "classes",
    f"""SELECT *, CAST(mask = 1 AND veg AS INTEGER) AS vegetation_loss,
        CAST(mask = 1 AND wat AS INTEGER) AS surface_water,
        CAST(mask = 1 AND NOT veg AND NOT wat AS INTEGER) AS new_construction FROM {clean}""",
)


def micro(ring: str, x: int = 1, y: int = 2) -> str:
    """A ring as text of millionths of a degree."""

    def part(i: int) -> str:
        return f"CAST(CAST(round(p[{i}] * 1e6) AS BIGINT) AS VARCHAR)"

    return f"array_to_string(list_transform({ring}, lambda p: {part(x)} || ' ' || {part(y)}), ',')"


# --- scans, sources, sinks -------------------------------------------------------------------------

register(
    "aoi_list",
    f"""SELECT aoi_id AS id, upper(aoi_id[1]) || lower(aoi_id[2:]) AS name,
        {micro('coords')} AS coordinates, date1, date2 FROM aois""",
)
register("band_scan", "SELECT * FROM long_bands")
register(
    "catalog_scan",
    """SELECT product_id, strftime(sensing_start, '%Y-%m-%d') AS sensing_day, product_type, cloud_cover,
       concat(a, ' ', b, ',', c, ' ', b, ',', c, ' ', d, ',', a, ' ', d, ',', a, ' ', b) AS footprint
       FROM (SELECT *, CAST(lon0 * 1000000 AS BIGINT) AS a, CAST(lat0 * 1000000 AS BIGINT) AS b,
             CAST((lon0 + 1) * 1000000 AS BIGINT) AS c, CAST((lat0 + 1) * 1000000 AS BIGINT) AS d
             FROM cat) WHERE product_type = 'S2MSI2A'""",
)
register("asset_paths", "SELECT * FROM assets")
register("pending_assets", "SELECT product_id, asset_key FROM assets WHERE product_id % 3 <> 0")
register("raster_roundtrip", "SELECT * FROM dated")
register(
    "artifact_names",
    """SELECT request_id, 'rgb_date1_' || aoi_id || '_' || d1 || '.png' AS raw_image,
       'rgb_date2_' || aoi_id || '_' || d2 || '.png' AS processed_image,
       'change_overlay_' || aoi_id || '_' || d2 || '.png' AS clean_map,
       'comparison_' || aoi_id || '_' || d2 || '.png' AS comparison,
       'interactive_map_' || aoi_id || '_' || d2 || '.html' AS map
       FROM (SELECT *, coalesce(date1, '2024-02-28') AS d1, coalesce(date2, '2026-04-03') AS d2 FROM reqs)""",
)
register(
    "legacy_artifact_names",
    """SELECT o_orderkey, 'raw_' || stem AS raw, 'processed_' || stem AS processed,
       'clean_change_map_' || stem AS clean_map, 'comparison_' || stem AS comparison
       FROM (SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) || '_'
             || strftime(o_orderdate, '%Y-%m-%d') || '_' || year(o_orderdate) || '.png' AS stem FROM orders)""",
)
register(
    "resolve_uri",
    """SELECT o_orderkey, CASE o_orderkey % 4
         WHEN 0 THEN 'http://localhost:8000/outputs/processed/' || o_orderkey || '.png'
         WHEN 1 THEN 'http://localhost:8000/outputs/' || o_orderkey
         WHEN 2 THEN 'outputs/' || o_orderkey END AS uri FROM orders""",
)
register(
    "placeholder_fill",
    """SELECT aoi_id, count(*) AS pixels, CAST(sum(row) AS BIGINT) AS sum_row,
       CAST(sum(col) AS BIGINT) AS sum_col, CAST(sum(red) AS BIGINT) AS sum_red,
       CAST(sum(green) AS BIGINT) AS sum_green, CAST(sum(blue) AS BIGINT) AS sum_blue
       FROM (SELECT aoi_id, row, col, red1 AS red, green1 AS green, blue1 AS blue FROM rgb
             UNION ALL
             SELECT aoi_id, i, j, 15, 32, 67 FROM (SELECT DISTINCT aoi_id FROM reqs
               WHERE aoi_id NOT IN (SELECT aoi_id FROM px)), range(512) a(i), range(512) b(j))
       GROUP BY aoi_id""",
)

# --- projections -----------------------------------------------------------------------------------

register("stack_bands", "SELECT * FROM dated")
register("unstack_bands", "SELECT * FROM long_bands")
register(
    "natural_rgb",
    f"""SELECT aoi_id, scene_date, row, col, {shade('b04')} AS red, {shade('b03')} AS green,
        {shade('b02')} AS blue FROM dated""",
)


def rounded(expr: str, digits: int, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {name}"


for index in ("ndvi", "ndwi"):
    register(
        index,
        f"""SELECT aoi_id, row, col, {rounded(f'{index}_1', 6, f'{index}_1')},
            {rounded(f'{index}_2', 6, f'{index}_2')} FROM idx""",
    )
register(
    "rgb_difference",
    f"SELECT aoi_id, row, col, {rounded('total_difference / 3.0::DOUBLE', 6, 'difference')} FROM flags",
)
register("change_mask", "SELECT aoi_id, row, col, mask FROM flags")
cte(
    "grays",
    f"""SELECT aoi_id, row, col, {gray('red1', 'green1', 'blue1')} AS gray1,
        {gray('red2', 'green2', 'blue2')} AS gray2 FROM rgb""",
)
register("grayscale", "SELECT * FROM grays")
register("gray_absdiff", "SELECT aoi_id, row, col, abs(gray1 - gray2) AS difference FROM grays")
register(
    "gray_change_mask",
    "SELECT aoi_id, row, col, CAST(abs(gray1 - gray2) > 30 AS INTEGER) AS mask FROM grays",
)
register(
    "index_deltas",
    f"""SELECT aoi_id, row, col, {rounded('CAST(ndvi_1 - ndvi_2 AS FLOAT)', 6, 'ndvi_drop')},
        {rounded('CAST(ndwi_2 - ndwi_1 AS FLOAT)', 6, 'ndwi_rise')} FROM idx""",
)
register(
    "classify_pixels",
    """SELECT aoi_id, row, col, CAST(mask = 1 AND NOT veg AND NOT wat AS INTEGER) AS new_construction,
       CAST(mask = 1 AND veg AS INTEGER) AS vegetation_loss,
       CAST(mask = 1 AND wat AS INTEGER) AS surface_water FROM flags""",
)
paint_c = chain("classes", "new_construction", [("max", 1)], "aoi_id", "pc")
paint_w = chain(paint_c, "surface_water", [("max", 1)], "aoi_id", "pw")
register(
    "change_overlay",
    "SELECT aoi_id, row, col, "
    + ", ".join(
        f"CASE WHEN surface_water = 1 THEN {w} WHEN new_construction = 1 THEN {c} ELSE {n}2 END AS {n}"
        for n, w, c in (("red", 0, 255), ("green", 100, 0), ("blue", 255, 0))
    )
    + f" FROM {paint_w}",
)

# --- geometry --------------------------------------------------------------------------------------

register("aoi_latlon", f"SELECT aoi_id, {micro('coords', 2, 1)} AS latlon FROM aois")
register(
    "ring_wkt",
    """SELECT aoi_id, 'POLYGON((' || array_to_string(list_transform(coords, lambda p:
       CAST(p[1] AS VARCHAR) || ' ' || CAST(p[2] AS VARCHAR)), ', ') || '))' AS wkt FROM aois""",
)


def forward(lon: str, lat: str, zone: int = 43) -> tuple[str, str, str]:
    """Lateral select list (xi, eta) and the expressions for easting and northing."""
    e = utm.ECCENTRICITY
    lam0 = f"radians({zone * 6 - 183}::DOUBLE)"
    sphi = f"sin(radians({lat}))"
    atanh = lambda x: f"(0.5 * ln((1.0 + {x}) / (1.0 - {x})))"
    tau = f"sinh({atanh(sphi)} - {e!r}::DOUBLE * {atanh(f'({e!r}::DOUBLE * {sphi})')})"
    dlam = f"(radians({lon}) - {lam0})"
    xi = f"atan2({tau}, cos({dlam}))"
    eta = atanh(f"(sin({dlam}) / sqrt({tau} * {tau} + 1.0))")
    k = utm.SCALE * utm.RECTIFYING_RADIUS
    x = " + ".join(
        ["eta"] + [f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(utm.ALPHA, 1)]
    )
    y = " + ".join(
        ["xi"] + [f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(utm.ALPHA, 1)]
    )
    return f"{xi} AS xi, {eta} AS eta", f"500000.0 + {k!r}::DOUBLE * ({x})", f"{k!r}::DOUBLE * ({y})"


def inverse(source: str, columns: str, zone: int = 43) -> str:
    """Query adding lon and lat to rows with x and y."""
    k = utm.SCALE * utm.RECTIFYING_RADIUS
    xi = " - ".join(
        ["xi0"] + [f"{b!r}::DOUBLE * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, b in enumerate(utm.BETA, 1)]
    )
    eta = " - ".join(
        ["eta0"] + [f"{b!r}::DOUBLE * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, b in enumerate(utm.BETA, 1)]
    )
    phi = " + ".join(["chi"] + [f"{d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(utm.DELTA, 1)])
    return f"""SELECT {columns}, degrees({phi}) AS lat,
        {zone * 6 - 183} + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM
        (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM
         (SELECT *, {xi} AS xi, {eta} AS eta FROM
          (SELECT *, y / {k!r}::DOUBLE AS xi0, (x - 500000.0) / {k!r}::DOUBLE AS eta0 FROM {source})))"""


_grid, _x, _y = forward("lon", "lat")
register(
    "to_utm",
    f"""SELECT aoi_id, row, col, {rounded(_x, 3, 'x')}, {rounded(_y, 3, 'y')} FROM
        (SELECT *, {_grid} FROM (SELECT aoi_id, row, col, (col * 95 + 73856313) / 1e6::DOUBLE AS lon,
         (18544483 - row * 90) / 1e6::DOUBLE AS lat FROM px))""",
)
cte(
    "pxy",
    """SELECT aoi_id, row, col, x0 + 10 * (col + 0.5::DOUBLE) AS x, y0 - 10 * (row + 0.5::DOUBLE) AS y
       FROM px JOIN meta USING (aoi_id)""",
)
register("pixel_xy", "SELECT * FROM pxy")
cte("plonlat", inverse("pxy", "aoi_id, row, col"))
register(
    "from_utm",
    f"SELECT aoi_id, row, col, {rounded('lon', 6, 'lon')}, {rounded('lat', 6, 'lat')} FROM plonlat",
)
cte(
    "win",
    """SELECT aoi_id, 4::BIGINT AS col_min, 95::BIGINT AS col_max, 1::BIGINT AS row_min,
       least(23, height - 1) AS row_max, x0, y0 FROM meta WHERE height > 1""",
)
register(
    "crop_window",
    """SELECT aoi_id, col_min, col_max, row_min, row_max, col_max - col_min + 1 AS crop_width,
       row_max - row_min + 1 AS crop_height, x0 + 10 * col_min AS crop_x0, y0 - 10 * row_min AS crop_y0
       FROM win""",
)
_quad_edges = ", ".join(
    f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(QUAD, [*QUAD[1:], QUAD[0]])
)
cte(
    "inside_cells",
    f"""SELECT row, col FROM range(25) a(row), range(100) b(col), (VALUES {_quad_edges}) e(x1, y1, x2, y2)
        WHERE (y1 > row + 0.5) <> (y2 > row + 0.5)
          AND col + 0.5 < (x2 - x1) * (row + 0.5::DOUBLE - y1) / (y2 - y1)::DOUBLE + x1
        GROUP BY row, col HAVING count(*) % 2 = 1""",
)
register(
    "clip_to_aoi",
    "SELECT aoi_id, scene_date, d.row, d.col, CAST(i.row IS NOT NULL AS INTEGER) AS inside, "
    + ", ".join(f"CASE WHEN i.row IS NULL THEN 0 ELSE {b} END AS {b}" for b in BANDS)
    + """ FROM dated d JOIN win USING (aoi_id)
       LEFT JOIN inside_cells i ON i.row = d.row AND i.col = d.col
       WHERE d.row BETWEEN row_min AND row_max AND d.col BETWEEN col_min AND col_max""",
)
cte(
    "border_xy",
    """SELECT aoi_id, x, y FROM (SELECT *, x0 + 1000 * i / 22.0::DOUBLE AS ax,
         y0 - 10 * height + 10 * height * i / 22.0::DOUBLE AS ay FROM meta, range(23) t(i)),
       LATERAL (VALUES (ax, y0), (ax, y0 - 10 * height), (x0, ay), (x0 + 1000, ay)) v(x, y)""",
)
cte("border_ll", inverse("border_xy", "aoi_id"))
cte(
    "boxes",
    """SELECT aoi_id, min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max
       FROM border_ll GROUP BY aoi_id""",
)
register(
    "bounds_center",
    "SELECT aoi_id, "
    + ", ".join(rounded(c, 6, c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))
    + f", {rounded('(lat_min + lat_max) / 2', 6, 'center_lat')},"
    + f" {rounded('(lon_min + lon_max) / 2', 6, 'center_lon')} FROM boxes",
)
register(
    "footprint_intersects",
    """SELECT o_orderkey, CAST(greatest(x - cx, cx - x - 2, 0) + greatest(y - cy, cy - y - 2, 0) <= 1.5
         AS INTEGER) AS hit FROM
       (SELECT o_orderkey, c_nationkey % 10 + 0.25::DOUBLE AS x, c_custkey % 10 + 0.25::DOUBLE AS y,
        o_orderkey % 10 + 0.0625::DOUBLE AS cx, o_orderkey // 10 % 10 + 0.28125::DOUBLE AS cy
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
)

# --- joins -----------------------------------------------------------------------------------------

_pair = ", ".join(f"a.{b} AS {b}_1, z.{b} AS {b}_2" for b in BANDS)
register(
    "pair_dates",
    f"""SELECT a.aoi_id, a.row, a.col, a.scene_date AS date1, z.scene_date AS date2, {_pair}
        FROM dated a JOIN dated z ON a.aoi_id = z.aoi_id AND a.row = z.row AND a.col = z.col
        WHERE z.scene_date = '{DATE2}'""",
)
register(
    "top_scenes",
    "SELECT aoi_id, product_id, cloud_cover, CAST(rank AS INTEGER) AS rank FROM found WHERE rank <= 5",
)
register(
    "select_scene",
    """SELECT aoi_id, product_id, cloud_cover, strftime(sensing_start, '%Y-%m-%d') AS sensing_day
       FROM found WHERE rank = 1""",
)
register("resolve_aoi", f"SELECT request_id, aoi_id, {micro('coords')} AS coords FROM resolved")
register(
    "rejected_requests",
    """SELECT request_id, aoi_id, 'AOI not in the library and no polygon given' AS reason FROM reqs
       WHERE coords IS NULL AND aoi_id NOT IN (SELECT aoi_id FROM aois)""",
)
register(
    "rejected_bad_input",
    """SELECT * FROM (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE 'hinjewadi' END AS aoi_id,
       CASE WHEN c_custkey % 4 NOT IN (1, 2) AND c_custkey % 3 = 0 THEN 'AOI not in the library and no polygon given'
            WHEN c_custkey % 4 = 1 THEN 'polygon needs three different points with two coordinates each'
            WHEN c_custkey % 5 = 0 THEN 'date is not yyyy-MM-dd' END AS reason FROM customer) WHERE reason IS NOT NULL""",
)
register(
    "default_dates",
    """SELECT request_id, coalesce(q.date1, a.date1, '2024-02-28') AS date1,
       coalesce(q.date2, a.date2, '2026-04-03') AS date2 FROM reqs q LEFT JOIN aois a USING (aoi_id)""",
)
register(
    "default_dates_array",
    """SELECT request_id, coalesce(q.date1, a.date2, '2024-02-28') AS date1,
       coalesce(q.date2, a.date1, '2026-04-03') AS date2 FROM reqs q LEFT JOIN aois a USING (aoi_id)""",
)

# --- neighbourhoods --------------------------------------------------------------------------------

for name, steps in {
    "erode": [("min", 1)],
    "dilate": [("max", 1)],
    "morph_open": OPEN3,
    "morph_open_5": OPEN5,
    "morph_close": CLOSE3,
    "morph_clean": OPEN3 + CLOSE3,
}.items():
    last = chain("flags", "mask", steps, "aoi_id", f"m_{name}")
    register(name, f"SELECT aoi_id, row, col, mask FROM {last}")

cte(
    "half",
    """SELECT aoi_id, row // 2 AS row, col // 2 AS col, red2 AS red, green2 AS green, blue2 AS blue
       FROM rgb WHERE row % 2 = 0 AND col % 2 = 0""",
)
cte("sizes", "SELECT aoi_id, 50 AS sw, (height + 1) // 2 AS sh, 100 AS dw, height AS dh FROM meta")
cte(
    "target",
    """SELECT p.aoi_id, p.row, p.col, fy, fx, fy - floor(fy) AS wy, fx - floor(fx) AS wx, sh, sw FROM
       (SELECT px.aoi_id, px.row, px.col, sh, sw,
        least(greatest((2 * px.row + 1) * sh / (2 * dh)::DOUBLE - 0.5, 0), sh - 1) AS fy,
        least(greatest((2 * px.col + 1) * sw / (2 * dw)::DOUBLE - 0.5, 0), sw - 1) AS fx
        FROM px JOIN sizes USING (aoi_id)) p""",
)
_mix = ", ".join(
    f"CAST(floor(round((1 - wy) * ((1 - wx) * a.{c} + wx * b.{c}) + wy * ((1 - wx) * c.{c} + wx * d.{c}), 7)"
    f" + 0.5) AS INTEGER) AS {c}"
    for c in ("red", "green", "blue")
)
cte(
    "image2",
    f"""SELECT t.aoi_id, t.row, t.col, {_mix} FROM target t
        JOIN half a ON a.aoi_id = t.aoi_id AND a.row = floor(fy) AND a.col = floor(fx)
        JOIN half b ON b.aoi_id = t.aoi_id AND b.row = floor(fy) AND b.col = least(floor(fx) + 1, sw - 1)
        JOIN half c ON c.aoi_id = t.aoi_id AND c.row = least(floor(fy) + 1, sh - 1) AND c.col = floor(fx)
        JOIN half d ON d.aoi_id = t.aoi_id AND d.row = least(floor(fy) + 1, sh - 1)
                   AND d.col = least(floor(fx) + 1, sw - 1)""",
)
register("resize_bilinear", "SELECT * FROM image2")


def legacy(second: str, prefix: str) -> str:
    """Opened 5x5 mask of grey differences between image 1 and ``second``."""
    name = cte(
        f"{prefix}_gray",
        f"""SELECT r.aoi_id, r.row, r.col, CAST(abs({gray('red1', 'green1', 'blue1')}
            - {gray('s.red', 's.green', 's.blue')}) > 30 AS INTEGER) AS mask
            FROM rgb r JOIN {second} s ON r.aoi_id = s.aoi_id AND r.row = s.row AND r.col = s.col""",
    )
    return chain(name, "mask", OPEN5, "aoi_id", prefix)


legacy_resized = legacy("image2", "lr")
cte("full2", "SELECT aoi_id, row, col, red2 AS red, green2 AS green, blue2 AS blue FROM rgb")
legacy_full = legacy("full2", "lf")
register(
    "side_by_side",
    f"""SELECT aoi_id, row, col, red1 AS red, green1 AS green, blue1 AS blue FROM rgb UNION ALL
        SELECT aoi_id, row, col + 100, red, green, blue FROM image2 UNION ALL
        SELECT aoi_id, row, col + 200, mask * 255, mask * 255, mask * 255 FROM {legacy_resized}""",
)

# --- aggregates ------------------------------------------------------------------------------------


def pct(n: str, total: str) -> str:
    return f"((20000 * {n} + {total}) // (2 * {total})) / 100.0::DOUBLE"


def area(n: str) -> str:
    return f"(({n} + 50) // 100) / 100.0::DOUBLE"


def counted(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS total_pixels, count(*) FILTER (mask = 1) AS changed_pixels,
        count(*) FILTER (mask = 1 AND NOT veg AND NOT wat) AS construction_pixels,
        count(*) FILTER (mask = 1 AND veg) AS vegetation_pixels,
        count(*) FILTER (mask = 1 AND wat) AS water_pixels FROM {source} GROUP BY {keys}"""


AREAS = (
    f"{area('construction_pixels')} AS new_construction_km2, {area('vegetation_pixels')} AS"
    f" vegetation_loss_km2, {area('water_pixels')} AS surface_water_km2"
)
CHANGE = f"{pct('changed_pixels', 'total_pixels')} AS change_percentage, {area('changed_pixels')} AS changed_area_km2"
cte("counts", counted(clean, "aoi_id"))
register("change_counts", "SELECT aoi_id, total_pixels, changed_pixels FROM counts")
register(
    "raw_change_counts",
    "SELECT aoi_id, count(*) AS total_pixels, count(*) FILTER (mask = 1) AS changed_pixels FROM flags GROUP BY aoi_id",
)
register("change_metrics", f"SELECT aoi_id, changed_pixels, {CHANGE} FROM counts")
register(
    "class_areas",
    f"SELECT aoi_id, construction_pixels, vegetation_pixels, water_pixels, {AREAS} FROM counts",
)


def legacy_summary(source: str) -> str:
    return f"""SELECT *, {pct('changed_pixels', 'total_pixels')} AS change_percentage,
        changed_pixels / 10000.0::DOUBLE AS changed_area_km2 FROM
        (SELECT aoi_id, count(*) AS total_pixels, count(*) FILTER (mask = 1) AS changed_pixels
         FROM {source} GROUP BY aoi_id)"""


register("legacy_metrics", legacy_summary(legacy_full))
register("detect_changes_legacy", legacy_summary(legacy_resized))
register(
    "legacy_document",
    f"""SELECT aoi_id, total_pixels, changed_pixels, change_percentage, changed_area_km2,
        'processed_' || aoi_id || '_2026-04-03_2026.png' AS processed,
        'clean_change_map_' || aoi_id || '_2026-04-03_2026.png' AS clean_map,
        'comparison_' || aoi_id || '_2026-04-03_2026.png' AS comparison FROM ({legacy_summary(legacy_resized)})""",
)
register(
    "raster_extent",
    """SELECT aoi_id, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max,
       count(*) AS pixels, max(col) - min(col) + 1 AS width, max(row) - min(row) + 1 AS height
       FROM px GROUP BY aoi_id""",
)

# --- ranks and samples -----------------------------------------------------------------------------


def ranked(source: str, keys: str) -> str:
    per_class = " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS class, row, col FROM {source} WHERE {c} = 1"
        for c in ("new_construction", "vegetation_loss", "surface_water")
    )
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys}, class ORDER BY row, col) - 1 AS rank,
        count(*) OVER (PARTITION BY {keys}, class) AS n FROM ({per_class})"""


cte("ranks", ranked("classes", "aoi_id"))
register("mask_rank", "SELECT * FROM ranks")


def sample(source: str, k: int) -> str:
    """Keep the ranks floor(i * (n - 1) / (k - 1)), i = 0 .. k - 1, or all when n <= k."""
    return f"""SELECT * EXCLUDE (n) FROM {source} r WHERE n <= {k} OR EXISTS
        (SELECT 1 FROM range({k}) t(i) WHERE (i * (r.n - 1)) // {k - 1} = r.rank)"""


register("even_sample", sample("ranks", 200))
register("even_sample_7", sample("ranks", 7))
cte("sampled", sample("ranks", 200))
cte(
    "points",
    """SELECT aoi_id, class, rank, lat, lon FROM sampled JOIN plonlat USING (aoi_id, row, col)
       WHERE class <> 'vegetation_loss'""",
)
register(
    "mask_points",
    f"SELECT aoi_id, class, rank, {rounded('lat', 6, 'lat')}, {rounded('lon', 6, 'lon')} FROM points",
)

# --- dates, documents, layers ----------------------------------------------------------------------

register(
    "date_window",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 5 AS VARCHAR) AS window_start,
       CAST(CAST(o_orderdate AS DATE) + 5 AS VARCHAR) AS window_end FROM orders""",
)
register(
    "feature_layers",
    f"""SELECT aoi_id, 'Yellow AOI Border' AS layer, 'Polygon' AS geometry,
        replace({micro('coords')}, ',', ' ') AS micro, 'AOI Boundary' AS label, 'yellow' AS color,
        3 AS size, 0.15::DOUBLE AS fill_opacity FROM aois UNION ALL
        SELECT aoi_id, CASE class WHEN 'new_construction' THEN 'Red Dots (New Construction)'
                       ELSE 'Blue Dots (Surface Water)' END, 'Point',
        CAST(CAST(round(lon * 1e6) AS BIGINT) AS VARCHAR) || ' '
        || CAST(CAST(round(lat * 1e6) AS BIGINT) AS VARCHAR),
        CASE class WHEN 'new_construction' THEN 'New Construction' ELSE 'Surface Water Change' END,
        CASE class WHEN 'new_construction' THEN 'red' ELSE 'blue' END, 5, 0.85::DOUBLE FROM points""",
)

# --- end to end ------------------------------------------------------------------------------------

cte(
    "jobs",
    """SELECT row_number() OVER (ORDER BY job) AS id, * FROM
       (SELECT aoi_id, coords, date1, date2, min(request_id) AS job FROM resolved
        GROUP BY aoi_id, coords, date1, date2)""",
)
_grid2, _x2, _y2 = forward("p[1]", "p[2]")
cte(
    "vertices",
    f"""SELECT job, aoi_id, i, height, width, ({_x2} - x0) / 10 AS cx, (y0 - ({_y2})) / 10 AS cy FROM
        (SELECT *, {_grid2} FROM (SELECT job, aoi_id, i, coords[i] AS p, height, width, x0, y0
         FROM jobs JOIN meta USING (aoi_id), range(1, 6) t(i)))""",
)
cte(
    "job_win",
    """SELECT job, aoi_id, greatest(floor(min(cx)), 0) AS c0, least(ceil(max(cx)), any_value(width)) - 1 AS c1,
       greatest(floor(min(cy)), 0) AS r0, least(ceil(max(cy)), any_value(height)) - 1 AS r1
       FROM vertices GROUP BY job, aoi_id""",
)
cte(
    "job_edges",
    """SELECT a.job, a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2
       FROM vertices a JOIN vertices b ON a.job = b.job AND b.i = a.i + 1""",
)
cte("job_cells", "SELECT job, aoi_id, row, col FROM job_win JOIN px USING (aoi_id) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
cte(
    "job_inside",
    """SELECT c.job, c.row, c.col FROM job_cells c JOIN job_edges e ON e.job = c.job
       WHERE (y1 > c.row + 0.5) <> (y2 > c.row + 0.5)
         AND c.col + 0.5 < (x2 - x1) * (c.row + 0.5::DOUBLE - y1) / (y2 - y1) + x1
       GROUP BY c.job, c.row, c.col HAVING count(*) % 2 = 1""",
)
_cut = ", ".join(
    f"CASE WHEN i.job IS NULL THEN 0 ELSE d{n}.{b} END AS {b}_{n}" for n in (1, 2) for b in BANDS
)
cte(
    "job_px",
    f"""SELECT c.job, c.aoi_id, j.date1, j.date2, c.row, c.col, {_cut} FROM job_cells c
        JOIN jobs j ON j.job = c.job
        JOIN dated d1 ON d1.aoi_id = c.aoi_id AND d1.row = c.row AND d1.col = c.col AND d1.scene_date = j.date1
        JOIN dated d2 ON d2.aoi_id = c.aoi_id AND d2.row = c.row AND d2.col = c.col AND d2.scene_date = j.date2
        LEFT JOIN job_inside i ON i.job = c.job AND i.row = c.row AND i.col = c.col""",
)
cte(
    "job_rgb",
    "SELECT *, "
    + ", ".join(
        f"{shade(f'{b}_{i}')} AS {c}{i}"
        for i in (1, 2)
        for b, c in (("b04", "red"), ("b03", "green"), ("b02", "blue"))
    )
    + " FROM job_px",
)
cte("job_idx", indexed("job_rgb"))
cte("job_flags", flagged("job_idx"))
job_clean = chain("job_flags", "mask", OPEN3 + CLOSE3, "job", "jc")
cte("job_counts", counted(job_clean, "job, aoi_id, date1, date2"))
cte(
    "detected",
    f"""SELECT r.request_id, c.* EXCLUDE (job), {CHANGE}, {AREAS} FROM job_counts c
        JOIN jobs j ON j.job = c.job
        JOIN resolved r ON r.aoi_id = j.aoi_id AND r.coords = j.coords AND r.date1 = j.date1 AND r.date2 = j.date2""",
)
register("detect_changes", "SELECT * FROM detected")
cte("job_sites", "SELECT j.*, w.r0, w.r1, w.c0, w.c1, CAST(substr(j.aoi_id, 5) AS BIGINT) AS site FROM jobs j JOIN job_win w ON w.job = j.job WHERE w.c1 >= w.c0 AND w.r1 >= w.r0")
cte(
    "job_gaps",
    """SELECT job, aoi_id, coords, date1, date2, list_distinct(list_filter([
         CASE WHEN date1 = '2026-04-03' THEN gap END, CASE WHEN date2 = '2026-04-03' THEN gap END], lambda x: x IS NOT NULL)) AS gaps
       FROM (SELECT *, CASE WHEN site % 2 = 1 THEN 'missing band B08 on 2026-04-03'
         WHEN site % 4 = 2 AND r0 < 7 THEN
           CASE WHEN r1 < 7 THEN 'no pixels on 2026-04-03'
           ELSE CAST(CAST((r1 - 6) * (c1 - c0 + 1) AS BIGINT) AS VARCHAR) || ' of '
             || CAST(CAST((r1 - r0 + 1) * (c1 - c0 + 1) AS BIGINT) AS VARCHAR) || ' pixels on 2026-04-03' END END AS gap
       FROM job_sites)""",
)
_ASKED = "resolved r ON r.aoi_id = g.aoi_id AND r.coords = g.coords AND r.date1 = g.date1 AND r.date2 = g.date2"
register(
    "incomplete_rasters",
    f"SELECT r.request_id, r.aoi_id, g.gaps[1] AS reason FROM job_gaps g JOIN {_ASKED} WHERE len(g.gaps) > 0",
)
register(
    "detect_complete_only",
    f"SELECT d.* FROM detected d WHERE d.request_id IN (SELECT r.request_id FROM job_gaps g JOIN {_ASKED} WHERE len(g.gaps) = 0)",
)
register("detect_changes_wide", "SELECT * FROM detected")
cte(
    "job_classes",
    f"""SELECT job AS job_id, aoi_id, date1, date2, row, col, CAST(mask = 1 AND wat AS INTEGER) AS surface_water,
        CAST(mask = 1 AND NOT veg AND NOT wat AS INTEGER) AS new_construction,
        0 AS vegetation_loss FROM {job_clean}""",
)
cte("job_ranks", ranked("job_classes", "job_id, aoi_id, date1, date2"))
register("detect_points", sample("job_ranks", 200))
cte(
    "job_masks",
    f"""SELECT job AS job_id, aoi_id, date1, date2, row, col, red2, green2, blue2, mask,
        CAST(mask = 1 AND veg AS INTEGER) AS vegetation_loss,
        CAST(mask = 1 AND wat AS INTEGER) AS surface_water,
        CAST(mask = 1 AND NOT veg AND NOT wat AS INTEGER) AS new_construction FROM {job_clean}""",
)
register("detect_masks", "SELECT * EXCLUDE (red2, green2, blue2) FROM job_masks")
job_paint_c = chain("job_masks", "new_construction", [("max", 1)], "job_id", "jpc")
job_paint_w = chain(job_paint_c, "surface_water", [("max", 1)], "job_id", "jpw")
register(
    "detect_overlay",
    "SELECT job_id, aoi_id, date1, date2, row, col, "
    + ", ".join(
        f"CASE WHEN surface_water = 1 THEN {w} WHEN new_construction = 1 THEN {c} ELSE {n}2 END AS {n}"
        for n, w, c in (("red", 0, 255), ("green", 100, 0), ("blue", 255, 0))
    )
    + f" FROM {job_paint_w}",
)
cte("job_sampled", sample("job_ranks", 200))
cte(
    "job_points",
    "SELECT job_id, aoi_id, date1, date2, class, lat, lon FROM job_sampled JOIN plonlat USING (aoi_id, row, col)",
)
register(
    "detect_features",
    f"""SELECT job AS job_id, aoi_id, date1, date2, 'Yellow AOI Border' AS layer, 'Polygon' AS geometry,
        replace({micro('coords')}, ',', ' ') AS micro, 'AOI Boundary' AS label, 'yellow' AS color,
        3 AS size, 0.15::DOUBLE AS fill_opacity FROM jobs
        WHERE job IN (SELECT job FROM job_win WHERE c0 <= c1 AND r0 <= r1) UNION ALL
        SELECT job_id, aoi_id, date1, date2,
        CASE class WHEN 'new_construction' THEN 'Red Dots (New Construction)'
                   ELSE 'Blue Dots (Surface Water)' END, 'Point',
        CAST(CAST(round(lon * 1e6) AS BIGINT) AS VARCHAR) || ' '
        || CAST(CAST(round(lat * 1e6) AS BIGINT) AS VARCHAR),
        CASE class WHEN 'new_construction' THEN 'New Construction' ELSE 'Surface Water Change' END,
        CASE class WHEN 'new_construction' THEN 'red' ELSE 'blue' END, 5, 0.85::DOUBLE FROM job_points""",
)
register(
    "unserved_requests",
    """SELECT request_id, aoi_id, 'no pixels of both dates inside the polygon' AS reason FROM resolved
       WHERE request_id NOT IN (SELECT request_id FROM detected)""",
)
_url = "'http://localhost:8000/outputs/processed/' || aoi_id || '/"
register(
    "metrics_document",
    f"""SELECT request_id, aoi_id, date1, date2, total_pixels, changed_pixels, change_percentage,
        changed_area_km2, new_construction_km2, vegetation_loss_km2, surface_water_km2,
        {_url}rgb_date1_' || aoi_id || '_' || date1 || '.png' AS raw_image_url,
        {_url}rgb_date2_' || aoi_id || '_' || date2 || '.png' AS processed_image_url,
        {_url}change_overlay_' || aoi_id || '_' || date2 || '.png' AS clean_map_url,
        {_url}comparison_' || aoi_id || '_' || date2 || '.png' AS comparison_url,
        {_url}interactive_map_' || aoi_id || '_' || date2 || '.html' AS map_url FROM detected""",
)
register(
    "result_summary",
    """SELECT q.request_id, upper(q.aoi_id) AS title,
       CAST(change_percentage AS VARCHAR) AS change_percentage,
       CAST(changed_area_km2 AS VARCHAR) AS changed_area_km2,
       coalesce(CAST(new_construction_km2 AS VARCHAR), 'N/A') AS new_construction_km2,
       coalesce(CAST(vegetation_loss_km2 AS VARCHAR), 'N/A') AS vegetation_loss_km2,
       coalesce(CAST(surface_water_km2 AS VARCHAR), 'N/A') AS surface_water_km2
       FROM reqs q LEFT JOIN detected d USING (request_id)""",
)
register(
    "plan_scenes",
    """SELECT product_id, asset_key FROM assets WHERE product_id % 3 <> 0
       AND product_id IN (SELECT product_id FROM found WHERE rank = 1)""",
)
register(
    "unmatched_scenes",
    """SELECT aoi_id, CAST(target_date AS VARCHAR) AS target_date FROM sreq
       WHERE aoi_id NOT IN (SELECT aoi_id FROM found)""",
)


cte(
    "job_border_xy",
    """SELECT job, x, y FROM (SELECT job, x0 + 10 * c0 AS left_x, x0 + 10 * (c1 + 1) AS right_x, y0 - 10 * r0 AS top_y,
         y0 - 10 * (r1 + 1) AS bottom_y, x0 + 10 * c0 + 10 * (c1 - c0 + 1) * i / 22.0::DOUBLE AS ax,
         y0 - 10 * (r1 + 1) + 10 * (r1 - r0 + 1) * i / 22.0::DOUBLE AS ay
         FROM job_sites JOIN meta USING (aoi_id), range(23) t(i)),
       LATERAL (VALUES (ax, top_y), (ax, bottom_y), (left_x, ay), (right_x, ay)) v(x, y)""",
)
cte("job_border_ll", inverse("job_border_xy", "job"))
cte(
    "job_boxes",
    """SELECT job, min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max
       FROM job_border_ll GROUP BY job""",
)
register(
    "job_bounds",
    "SELECT b.job AS job_id, aoi_id, date1, date2, "
    + ", ".join(rounded(c, 6, c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))
    + f", {rounded('(lat_min + lat_max) / 2', 6, 'center_lat')},"
    + f" {rounded('(lon_min + lon_max) / 2', 6, 'center_lon')} FROM job_boxes b JOIN jobs j ON j.job = b.job",
)

# --- through the sinks ------------------------------------------------------------------------------

register("mask_sink", "SELECT job_id, aoi_id, date1, date2, row, col, mask FROM job_masks")
ORACLE["overlay_sink"] = ORACLE["detect_overlay"]
ORACLE["feature_sink"] = ORACLE["detect_features"]


def both_dates(name: str, values: list[str], source: str) -> None:
    """One row per distinct date; ``values`` end in the number of the date."""
    parts = [
        f"SELECT job AS job_id, aoi_id, date1, date2, date{i} AS scene_date, row, col, {', '.join(v.format(i=i) for v in values)} FROM {source}"
        for i in (1, 2)
    ]
    register(name, " UNION ".join(parts))


both_dates("rgb_sink", ["red{i} AS red", "green{i} AS green", "blue{i} AS blue"], "job_rgb")
both_dates("ndvi_sink", ["round(CAST(ndvi_{i} AS DOUBLE), 6) + 0.0 AS ndvi"], "job_idx")
both_dates("ndwi_sink", ["round(CAST(ndwi_{i} AS DOUBLE), 6) + 0.0 AS ndwi"], "job_idx")

# --- requests that share an id; scenes of a catalogue ------------------------------------------------


def between_dates(p: str) -> str:
    """From ``{p}_px`` (job, aoi_id, date1, date2, row, col, bands of both dates) to counts; returns the last CTE's name."""
    colours = ", ".join(
        f"{shade(f'{b}_{i}')} AS {c}{i}" for i in (1, 2) for b, c in (("b04", "red"), ("b03", "green"), ("b02", "blue"))
    )
    cte(f"{p}_rgb", f"SELECT *, {colours} FROM {p}_px")
    cte(f"{p}_idx", indexed(f"{p}_rgb"))
    cte(f"{p}_flags", flagged(f"{p}_idx"))
    last = chain(f"{p}_flags", "mask", OPEN3 + CLOSE3, "job", f"{p}_c")
    return cte(f"{p}_counts", counted(last, "job, aoi_id, date1, date2"))


def inside_of(p: str) -> None:
    """``{p}_inside``: cells (job, row, col) of ``{p}_cells`` inside the ring whose ``{p}_vertices`` are job, i, cx, cy."""
    cte(
        f"{p}_edges",
        f"""SELECT a.job, a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2
            FROM {p}_vertices a JOIN {p}_vertices b ON a.job = b.job AND b.i = a.i + 1""",
    )
    cte(
        f"{p}_inside",
        f"""SELECT c.job, c.row, c.col FROM {p}_cells c JOIN {p}_edges e ON e.job = c.job
            WHERE (y1 > c.row + 0.5) <> (y2 > c.row + 0.5)
              AND c.col + 0.5 < (x2 - x1) * (c.row + 0.5::DOUBLE - y1) / (y2 - y1) + x1
            GROUP BY c.job, c.row, c.col HAVING count(*) % 2 = 1""",
    )


_own_shared = lonlat([("(v * 7 + 8)", "2"), ("(88 - v * 4)", "(v + 3)"), ("84", "21"), ("14", "22")], "s")
cte(
    "sh_asked",
    f"""SELECT CASE WHEN c % 15 <> 7 THEN c // 4 END AS request_id, a.aoi_id, '{DATE1}' AS date1, '{DATE2}' AS date2,
        CASE WHEN c % 2 = 1 THEN {_own_shared} ELSE a.coords END AS coords
        FROM (SELECT c_custkey AS c, c_custkey % 3 AS v, c_custkey % 4 AS s FROM customer WHERE c_custkey <= 60)
        LEFT JOIN aois a ON a.aoi_id = 'site' || s""",
)
cte("sh_known", "SELECT * FROM sh_asked WHERE coords IS NOT NULL AND aoi_id IS NOT NULL")
cte(
    "sh_jobs",
    """SELECT row_number() OVER (ORDER BY aoi_id, coords) AS job, * FROM (SELECT DISTINCT aoi_id, date1, date2, coords FROM sh_known)""",
)
cte(
    "sh_vertices",
    f"""SELECT job, aoi_id, i, height, width, ({_x2} - x0) / 10 AS cx, (y0 - ({_y2})) / 10 AS cy FROM
        (SELECT *, {_grid2} FROM (SELECT job, aoi_id, i, coords[i] AS p, height, width, x0, y0
         FROM sh_jobs JOIN meta USING (aoi_id), range(1, 6) t(i)))""",
)
cte(
    "sh_win",
    """SELECT job, aoi_id, greatest(floor(min(cx)), 0) AS c0, least(ceil(max(cx)), any_value(width)) - 1 AS c1,
       greatest(floor(min(cy)), 0) AS r0, least(ceil(max(cy)), any_value(height)) - 1 AS r1
       FROM sh_vertices GROUP BY job, aoi_id""",
)
cte("sh_cells", "SELECT job, aoi_id, row, col FROM sh_win JOIN px USING (aoi_id) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
inside_of("sh")
_sh_cut = ", ".join(f"CASE WHEN i.job IS NULL THEN 0 ELSE p.{b}_{n} END AS {b}_{n}" for n in (1, 2) for b in BANDS)
cte(
    "sh_px",
    f"""SELECT c.job, c.aoi_id, j.date1, j.date2, c.row, c.col, {_sh_cut} FROM sh_cells c
        JOIN sh_jobs j ON j.job = c.job JOIN px p ON p.aoi_id = c.aoi_id AND p.row = c.row AND p.col = c.col
        LEFT JOIN sh_inside i ON i.job = c.job AND i.row = c.row AND i.col = c.col""",
)
_sh_counts = between_dates("sh")
register(
    "requests_sharing_an_id",
    f"""SELECT r.request_id, c.* EXCLUDE (job), {CHANGE}, {AREAS} FROM {_sh_counts} c JOIN sh_jobs j ON j.job = c.job
        JOIN sh_known r ON r.aoi_id = j.aoi_id AND r.coords = j.coords""",
)

# Products are rows of the one grid of all sites: line r, column col.
cte(
    "prod",
    """SELECT 4 * n + k AS id, k % 2 AS slot, 25 * n + CASE WHEN k > 1 THEN 12 ELSE 0 END AS top, total,
       CAST(CASE WHEN k % 2 = 0 THEN DATE '2024-02-28' ELSE DATE '2026-04-03' END + CAST((4 * n + k) * 5 % 7 - 3 AS INTEGER) AS DATE) AS day,
       (4 * n + k) * 37 % 101 AS cloud, (4 * n + k) % 5 <> 4 AS searched,
       (18544533 - (2259 * n + CASE WHEN k > 1 THEN 1080 ELSE 0 END)) / 1e6::DOUBLE AS high,
       (18542183 - (2259 * n + CASE WHEN k > 1 THEN 1080 ELSE 0 END)) / 1e6::DOUBLE AS low
       FROM (SELECT max(r) + 1 AS total FROM ev), LATERAL (SELECT unnest(range(0, (total - 1) // 25 + 1)) AS n), range(4) t(k)
       WHERE 25 * n + CASE WHEN k > 1 THEN 12 ELSE 0 END < total""",
)
cte("products", "SELECT *, least(25, total - top) AS lines FROM prod")
_plot = lonlat([("(v * 5 + 10)", "15"), ("(80 - v * 3)", "(v + 17)"), ("85", "33"), ("12", "(36 - v)")], "s")
cte(
    "plot",
    f"""SELECT 'plot' || c AS aoi_id, {_plot} AS coords FROM (SELECT DISTINCT c_custkey % 20 AS c, c_custkey % 20 % 5 AS v, c_custkey % 20 % 4 AS s FROM customer)""",
)
cte(
    "plot_asked",
    """SELECT c_custkey AS request_id, aoi_id, coords,
       CAST(DATE '2024-02-28' + CAST(c_custkey % 3 * 5 - 6 AS INTEGER) AS VARCHAR) AS date1,
       CAST(DATE '2026-04-03' + CAST(c_custkey % 2 * 3 - 1 AS INTEGER) AS VARCHAR) AS date2
       FROM customer JOIN plot ON aoi_id = 'plot' || (c_custkey % 20)""",
)
cte("pl_jobs", "SELECT row_number() OVER (ORDER BY aoi_id, date1, date2) AS job, * FROM (SELECT DISTINCT aoi_id, coords, date1, date2 FROM plot_asked)")
cte("pl_dates", "SELECT job, aoi_id, coords, 0 AS slot, date1 AS day FROM pl_jobs UNION ALL SELECT job, aoi_id, coords, 1, date2 FROM pl_jobs")
cte(
    "pl_found",
    """SELECT * FROM (SELECT j.job, j.slot, p.id, p.top, p.lines, row_number() OVER (PARTITION BY j.job, j.slot ORDER BY p.cloud, p.id) AS rank
       FROM pl_dates j JOIN products p ON p.searched AND abs(date_diff('day', CAST(j.day AS DATE), p.day)) <= 5
        AND list_min(list_transform(j.coords, lambda q: q[2])) <= p.high AND list_max(list_transform(j.coords, lambda q: q[2])) >= p.low)
       WHERE rank <= 5""",
)


def on_grid(p: str, source: str) -> None:
    """``{p}_vertices`` of the rings of ``source`` (job, coords) in lines and columns of the one grid."""
    cte(
        f"{p}_vertices",
        f"""SELECT job, i, ({_x2} - 379290) / 10 AS cx, (2050820 - ({_y2})) / 10 AS cy FROM
            (SELECT *, {_grid2} FROM (SELECT job, i, coords[i] AS p FROM {source}, range(1, 6) t(i)))""",
    )
    cte(f"{p}_box", f"SELECT job, floor(min(cx)) AS x1, ceil(max(cx)) AS x2, floor(min(cy)) AS y1, ceil(max(cy)) AS y2 FROM {p}_vertices GROUP BY job")


on_grid("pl", "pl_jobs")
cte("pl_src", "SELECT f.* FROM pl_found f JOIN pl_box b USING (job) WHERE b.y1 < f.top + f.lines AND b.y2 > f.top AND b.x1 < 100 AND b.x2 > 0")
cte(
    "pl_win",
    """SELECT job, greatest(y1, max(t)) AS r0, least(y2, min(b)) - 1 AS r1, greatest(x1, 0) AS c0, least(x2, 100) - 1 AS c1
       FROM (SELECT job, slot, min(top) AS t, max(top + lines) AS b FROM pl_src GROUP BY job, slot) JOIN pl_box USING (job)
       GROUP BY job, y1, y2, x1, x2 HAVING count(*) = 2""",
)
cte("pl_cells", "SELECT job, r AS row, col FROM pl_win, range(100) t(col), (SELECT DISTINCT r FROM ev) WHERE r BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
inside_of("pl")
cte(
    "pl_best",
    """SELECT job, slot, row, arg_min(id, rank) AS id FROM (SELECT DISTINCT job, row FROM pl_cells) JOIN pl_src USING (job)
       WHERE row BETWEEN top AND top + lines - 1 GROUP BY job, slot, row""",
)
cte(
    "pl_lines",
    """SELECT w.job, (w.c1 - w.c0 + 1) * (w.r1 - w.r0 + 1) AS area, (w.c1 - w.c0 + 1) * count(*) FILTER (slot = 0) AS n0,
       (w.c1 - w.c0 + 1) * count(*) FILTER (slot = 1) AS n1 FROM pl_win w LEFT JOIN pl_best b ON b.job = w.job
       WHERE w.r1 >= w.r0 AND w.c1 >= w.c0 GROUP BY w.job, w.c0, w.c1, w.r0, w.r1""",
)
cte("grid", "SELECT 25 * CAST(substr(aoi_id, 5) AS BIGINT) + row AS line, * FROM px")
_pl_cut = ", ".join(
    f"CASE WHEN i.job IS NULL THEN 0 ELSE g.{b}_{n}{f' + CASE WHEN s{n}.id % 4 > 1 THEN 7 ELSE 0 END' if b == 'b02' else ''} END AS {b}_{n}"
    for n in (1, 2)
    for b in BANDS
)
cte(
    "pl_px",
    f"""SELECT c.job, j.aoi_id, j.date1, j.date2, c.row, c.col, {_pl_cut} FROM pl_cells c JOIN pl_jobs j ON j.job = c.job
        JOIN pl_lines l ON l.job = c.job AND l.n0 = l.area AND l.n1 = l.area
        JOIN grid g ON g.line = c.row AND g.col = c.col
        JOIN pl_best s1 ON s1.job = c.job AND s1.row = c.row AND s1.slot = 0
        JOIN pl_best s2 ON s2.job = c.job AND s2.row = c.row AND s2.slot = 1
        LEFT JOIN pl_inside i ON i.job = c.job AND i.row = c.row AND i.col = c.col""",
)
_pl_counts = between_dates("pl")
_PLOT = "plot_asked r ON r.aoi_id = j.aoi_id AND r.date1 = j.date1 AND r.date2 = j.date2"
cte("pl_detected", f"SELECT r.request_id, c.* EXCLUDE (job), {CHANGE}, {AREAS} FROM {_pl_counts} c JOIN pl_jobs j ON j.job = c.job JOIN {_PLOT}")
register("detect_from_catalog", "SELECT * FROM pl_detected")


def _lacking(n: str, day: str) -> str:
    return f"""CASE WHEN {n} = 0 THEN 'no pixels on ' || {day} WHEN {n} < area THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) || ' of '
               || CAST(CAST(area AS BIGINT) AS VARCHAR) || ' pixels on ' || {day} END"""


register(
    "unserved_catalog",
    f"""SELECT r.request_id, r.aoi_id, CASE WHEN NOT f0 OR NOT f1 THEN concat_ws('; ',
          CASE WHEN NOT f0 THEN 'no scene within 5 days of ' || j.date1 END, CASE WHEN NOT f1 THEN 'no scene within 5 days of ' || j.date2 END)
        WHEN coalesce(n0 + n1, 0) > 0 THEN concat_ws('; ', {_lacking('n0', 'j.date1')}, {_lacking('n1', 'j.date2')})
        ELSE 'no raster of the chosen scenes holds the polygon' END AS reason
        FROM (SELECT j.*, EXISTS (SELECT 1 FROM pl_found f WHERE f.job = j.job AND f.slot = 0) AS f0,
              EXISTS (SELECT 1 FROM pl_found f WHERE f.job = j.job AND f.slot = 1) AS f1 FROM pl_jobs j) j
        LEFT JOIN pl_lines l ON l.job = j.job JOIN {_PLOT}
        WHERE r.request_id NOT IN (SELECT request_id FROM pl_detected)""",
)
register(
    "catalog_sources",
    f"""SELECT r.request_id, r.aoi_id, CAST(slot + 1 AS INTEGER) AS date, s.id AS product_id, CAST(s.rank AS INTEGER) AS rank
        FROM pl_src s JOIN pl_lines l ON l.job = s.job JOIN pl_jobs j ON j.job = s.job JOIN {_PLOT}""",
)
cte("mo_jobs", "SELECT aoi_id AS job, coords FROM plot")
on_grid("mo", "mo_jobs")
cte(
    "mo_src",
    """SELECT job, id, top, lines, row_number() OVER (PARTITION BY job ORDER BY id DESC) AS rank, y1, y2, x1, x2 FROM mo_box, products
       WHERE slot = 0 AND y1 < top + lines AND y2 > top AND x1 < 100 AND x2 > 0""",
)
cte(
    "mo_win",
    """SELECT job, greatest(y1, min(top)) AS r0, least(y2, max(top + lines)) - 1 AS r1, greatest(x1, 0) AS c0, least(x2, 100) - 1 AS c1
       FROM mo_src GROUP BY job, y1, y2, x1, x2""",
)
cte("mo_cells", "SELECT job, line AS row, col, r0, c0, b02_1, b03_1, b04_1, b08_1 FROM mo_win, grid WHERE line BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
inside_of("mo")
cte("mo_first", "SELECT job, row, min(rank) AS rank, max(id) AS id FROM (SELECT DISTINCT job, row FROM mo_cells) JOIN mo_src USING (job) WHERE row BETWEEN top AND top + lines - 1 GROUP BY job, row")
register(
    "clip_mosaic",
    "SELECT c.job AS aoi_id, CAST(c.row - r0 AS BIGINT) AS row, CAST(c.col - c0 AS BIGINT) AS col, CAST(i.job IS NOT NULL AS INTEGER) AS inside, CAST(f.rank AS INTEGER) AS rank, "
    + ", ".join(
        f"CAST(CASE WHEN i.job IS NULL THEN 0 ELSE c.{b}_1{' + CASE WHEN f.id % 4 > 1 THEN 7 ELSE 0 END' if b == 'b02' else ''} END AS INTEGER) AS {b}"
        for b in BANDS
    )
    + """ FROM mo_cells c JOIN mo_first f ON f.job = c.job AND f.row = c.row
          LEFT JOIN mo_inside i ON i.job = c.job AND i.row = c.row AND i.col = c.col""",
)
ORACLE["footprint_intersects_seam"] = ORACLE["footprint_intersects"]

# --- projection by EPSG code -------------------------------------------------------------------------

cte(
    "coded",
    """SELECT aoi_id, row, col, CAST([32643, 4326, 3857, 2154][(row + col) % 4 + 1] AS INTEGER) AS epsg,
       (col * 95 + 73856313) / 1e6::DOUBLE AS lon, (18544483 - row * 90) / 1e6::DOUBLE AS lat FROM px""",
)
_R = "6378137.0::DOUBLE"
_cx = f"CASE epsg WHEN 32643 THEN {_x} WHEN 4326 THEN lon WHEN 3857 THEN radians(lon) * {_R} END"
_cy = f"CASE epsg WHEN 32643 THEN {_y} WHEN 4326 THEN lat WHEN 3857 THEN asinh(tan(radians(lat))) * {_R} END"
register("to_crs", f"SELECT aoi_id, row, col, epsg, {rounded(_cx, 3, 'x')}, {rounded(_cy, 3, 'y')} FROM (SELECT *, {_grid} FROM coded)")
cte("coded_utm", "SELECT aoi_id, row, col, epsg, lon AS lon0, lat AS lat0, col * 10 + 379295.0::DOUBLE AS x, 2050815.0::DOUBLE - row * 10 AS y FROM coded")
cte("coded_ll", inverse("coded_utm", "aoi_id, row, col, epsg, lon0, lat0"))
_lon = f"CASE epsg WHEN 32643 THEN lon WHEN 4326 THEN lon0 WHEN 3857 THEN degrees((col * 10 + 8221000.0::DOUBLE) / {_R}) END"
_lat = f"CASE epsg WHEN 32643 THEN lat WHEN 4326 THEN lat0 WHEN 3857 THEN degrees(atan(sinh((2100000.0::DOUBLE - row * 10) / {_R}))) END"
register("from_crs", f"SELECT aoi_id, row, col, epsg, {rounded(_lon, 6, 'lon_out')}, {rounded(_lat, 6, 'lat_out')} FROM coded_ll")

# --- what is left to do, and what a search found -----------------------------------------------------

register("pending_jobs", "SELECT job AS first_request, aoi_id, date1, date2 FROM jobs WHERE job % 2 <> 0")
cte(
    "outcomes",
    """SELECT q.aoi_id, CAST(q.target_date AS VARCHAR) AS target_date, f.product_id,
       CASE WHEN f.product_id IS NULL THEN 'unmatched' WHEN f.product_id % 11 = 0 THEN 'unlocated' ELSE 'chosen' END AS outcome
       FROM sreq q LEFT JOIN (SELECT * FROM found WHERE rank = 1) f USING (aoi_id)""",
)
register("scene_outcomes", "SELECT * FROM outcomes")
register("unlocated_scenes", "SELECT DISTINCT product_id FROM outcomes WHERE outcome = 'unlocated'")
register(
    "scene_placeholders",
    """SELECT aoi_id, target_date, count(*) AS pixels, CAST(sum(i) AS BIGINT) AS sum_row, CAST(sum(j) AS BIGINT) AS sum_col,
       CAST(sum(15) AS BIGINT) AS sum_red, CAST(sum(32) AS BIGINT) AS sum_green, CAST(sum(67) AS BIGINT) AS sum_blue
       FROM outcomes, range(8) a(i), range(8) b(j) WHERE outcome = 'unmatched' GROUP BY aoi_id, target_date""",
)
