"""Zones, resampling, neighbourhoods, texture and edges on dense rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import AFFINE, CENTER, classes, classified, grid, landcover, query, rd, rounded, rq
from rasterloom.functions import geo
from rasterloom.operators import edges as ed, focal, resample as rs, texture as tx, zones as zo

EDGES = [0, 200, 400, 600]
TILE = 64
D = ", dims AS (SELECT max(\"row\") + 1 AS h, max(col) + 1 AS w FROM {t})"


def reflect(c: str, n: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN 2 * {n} - 1 - ({c}) ELSE {c} END)"


def stencil(src: str, value: str, taps: str, out: str, pick: str = "g.*") -> str:
    """SQL: correlate `src` with a taps table (dy, dx, weights) under
    symmetric reflection."""
    r, c = reflect('g."row" + t.dy', "d.h"), reflect("g.col + t.dx", "d.w")
    return (
        f'SELECT t."row", t.col, {out} FROM (SELECT {pick}, t.*, {r} AS rr, {c} AS cc FROM {src} g CROSS JOIN dims d CROSS JOIN {taps} t) t '
        f'JOIN {src} s ON s."row" = t.rr AND s.col = t.cc GROUP BY t."row", t.col'
    )


# ------------------------------------------------------------------ zones

_XY = '600000.0::DOUBLE + (col + 0.5::DOUBLE) * 10.0::DOUBLE - {cx}::DOUBLE AS dx, 1200000.0::DOUBLE - ("row" + 0.5::DOUBLE) * 10.0::DOUBLE - {cy}::DOUBLE AS dy'.format(cx=CENTER[0], cy=CENTER[1])
_Z = f""", o AS (SELECT *, {_XY} FROM classified), z AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist,
  CASE WHEN sqrt(dx * dx + dy * dy) < 200 THEN '0-200' WHEN sqrt(dx * dx + dy * dy) < 400 THEN '200-400' WHEN sqrt(dx * dx + dy * dy) < 600 THEN '400-600' END AS ring,
  CAST(floor((degrees(atan2(dx, dy)) + 382.5::DOUBLE) % 360 / 45) AS INT) AS sector FROM o)"""
_DIR = "['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][sector + 1]"


def _zoned(spark, d):
    return zo.with_zone(classified(spark, d), AFFINE, CENTER, EDGES)


_RD = _Z + f""", f AS (SELECT y."year", r.ring, CAST(s.sector AS INT) AS sector FROM (SELECT DISTINCT "year" FROM z) y, (SELECT unnest(['0-200', '200-400', '400-600']) AS ring) r, (SELECT unnest(range(8)) AS sector) s),
 c AS (SELECT "year", ring, sector, count(*) AS n, count_if(class = 3) AS b FROM z WHERE ring IS NOT NULL GROUP BY 1, 2, 3),
 rdt AS (SELECT f."year", f.ring, f.sector, coalesce(n, 0) * 0.01::DOUBLE AS zone_ha, coalesce(b, 0) * 0.01::DOUBLE AS builtup_ha, coalesce(100.0::DOUBLE * b / n, 0) AS builtup_pct, {_DIR.replace('sector', 'f.sector')} AS direction
   FROM f LEFT JOIN c ON f."year" = c."year" AND f.ring = c.ring AND f.sector = c.sector)"""


@query("ring_direction", _RD + f"""SELECT "year", ring, sector, direction, {rq('zone_ha')} AS zone_ha, {rq('builtup_ha')} AS builtup_ha, {rq('builtup_pct')} AS builtup_pct FROM rdt""", needs=("classified",))
def ring_direction(spark, d):
    return rounded(zo.ring_direction_table(_zoned(spark, d), 0.01, EDGES), "zone_ha", "builtup_ha", "builtup_pct")


@query("ring_rollup", _RD + f""", u AS (SELECT "year", 'ring' AS kind, ring AS zone, sum(zone_ha) AS zone_ha, sum(builtup_ha) AS builtup_ha FROM rdt GROUP BY 1, 3
 UNION ALL SELECT "year", 'direction', direction, sum(zone_ha), sum(builtup_ha) FROM rdt GROUP BY 1, 3)
SELECT "year", kind, zone, {rq('zone_ha')} AS zone_ha, {rq('builtup_ha')} AS builtup_ha, {rq('100.0::DOUBLE * builtup_ha / nullif(zone_ha, 0)')} AS builtup_pct,
 CAST(CASE WHEN kind = 'ring' THEN CAST(split_part(zone, '-', 1) AS INT) ELSE list_position(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], zone) END AS INT) AS ord FROM u""", needs=("classified",))
def ring_rollup(spark, d):
    table = zo.ring_direction_table(_zoned(spark, d), 0.01, EDGES)
    return rounded(zo.zone_order(zo.zone_rollup(table)), "zone_ha", "builtup_ha", "builtup_pct")


@query("ring_coverage", _Z + f"""SELECT ring, {rq('count(*) * 50.0::DOUBLE', 2)} AS actual_m2,
 {rq('any_value(pi() * CASE ring WHEN \'0-200\' THEN 40000.0 WHEN \'200-400\' THEN 120000.0 ELSE 200000.0 END)', 2)} AS theoretical_m2,
 {rq('count(*) * 50.0::DOUBLE / any_value(pi() * CASE ring WHEN \'0-200\' THEN 40000.0 WHEN \'200-400\' THEN 120000.0 ELSE 200000.0 END)')} AS coverage FROM z WHERE ring IS NOT NULL GROUP BY 1""", needs=("classified",))
def ring_coverage(spark, d):
    out = zo.ring_coverage(_zoned(spark, d), 50.0, EDGES)
    return rounded(rounded(out, "actual_m2", "theoretical_m2", digits=2), "coverage")


@query("ring_share", _Z + f"""SELECT "year", ring, {rq('100.0::DOUBLE * sum(CASE WHEN class = 3 THEN 0.01::DOUBLE ELSE 0 END) / sum(0.01::DOUBLE)')} AS builtup_pct,
 {rq('sum(CASE WHEN class = 3 THEN 0.01::DOUBLE ELSE 0 END)')} AS builtup_ha FROM z WHERE ring IS NOT NULL GROUP BY 1, 2""", needs=("classified",))
def ring_share(spark, d):
    return rounded(zo.ring_share(_zoned(spark, d), F.lit(0.01)), "builtup_pct", "builtup_ha")


@query("center_distance", _Z + f"""SELECT "year", "row", col, {rq('CASE WHEN dist <= 450 THEN dist END')} AS dist FROM z""", needs=("classified",))
def center_distance(spark, d):
    x, y = geo.pixel_center(F.col("row"), F.col("col"), AFFINE)
    dist = geo.distance_to(x, y, *CENTER, cap=450)
    return classified(spark, d).select("year", "row", "col", rd(dist).alias("dist"))


@query("center_box", _Z + """SELECT "year", class, count(*) AS n FROM z WHERE abs(dx) <= 150 AND abs(dy) <= 150 GROUP BY 1, 2""", needs=("classified",))
def center_box(spark, d):
    x, y = geo.pixel_center(F.col("row"), F.col("col"), AFFINE)
    near = classified(spark, d).where(geo.in_box(x, y, *CENTER, 150.0))
    return near.groupBy("year", "class").agg(F.count(F.lit(1)).alias("n"))


@query("pixel_window", """SELECT "row", col, v FROM grid WHERE "row" >= 20 AND "row" < 61 AND col >= 15 AND col < 56""", needs=("grid",))
def pixel_window(spark, d):
    r0, r1, c0, c1 = geo.pixel_window((600153.0, 1199391.0, 600558.0, 1199798.0), AFFINE)
    inside = (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    return grid(spark, d).where(inside).select("row", "col", "v")


# -------------------------------------------------------------- resampling

@query("downsample_mean", f"""SELECT CAST(floor("row" / 3) AS INT) AS "row", CAST(floor(col / 3) AS INT) AS col, {rq('avg(v)')} AS v FROM grid GROUP BY 1, 2""", needs=("grid",))
def downsample_mean(spark, d):
    return rounded(rs.downsample_mean(grid(spark, d), ["v"], 3), "v")


_AXIS = """SELECT i, CAST(t AS INT) AS t, least((i + 1) * m / n::DOUBLE, t + 1) - greatest(i * m / n::DOUBLE, t) AS w FROM (SELECT unnest(range({n})) AS i, {n} AS n, {m} AS m, {m} AS mm), (SELECT unnest(range({m})) AS t)
 WHERE least((i + 1) * m / n::DOUBLE, t + 1) - greatest(i * m / n::DOUBLE, t) > 0"""


@query("decimate", D.format(t="grid") + f""", o AS (SELECT h, w, greatest(1, CAST(floor(h * least(1.0, 64.0::DOUBLE / greatest(h, w))) AS INT)) AS oh, greatest(1, CAST(floor(w * least(1.0, 64.0::DOUBLE / greatest(h, w))) AS INT)) AS ow FROM dims),
 r AS (SELECT i, t, least((i + 1) * oh / h::DOUBLE, t + 1) - greatest(i * oh / h::DOUBLE, t) AS s FROM (SELECT unnest(range(h)) AS i, h, oh FROM o), (SELECT CAST(unnest(range(oh)) AS INT) AS t FROM o)
   WHERE least((i + 1) * oh / h::DOUBLE, t + 1) - greatest(i * oh / h::DOUBLE, t) > 0),
 c AS (SELECT i, t, least((i + 1) * ow / w::DOUBLE, t + 1) - greatest(i * ow / w::DOUBLE, t) AS s FROM (SELECT unnest(range(w)) AS i, w, ow FROM o), (SELECT CAST(unnest(range(ow)) AS INT) AS t FROM o)
   WHERE least((i + 1) * ow / w::DOUBLE, t + 1) - greatest(i * ow / w::DOUBLE, t) > 0)
SELECT r.t AS "row", c.t AS col, {rq('sum(g.v * r.s * c.s) / sum(r.s * c.s)', 2)} AS v FROM grid g JOIN r ON r.i = g."row" JOIN c ON c.i = g.col GROUP BY 1, 2""", needs=("grid",))
def decimate(spark, d):
    g = grid(spark, d)
    return rounded(rs.decimate(g, ["v"], focal.raster_extent(g), 64), "v", digits=2)


@query("resample_nearest", """SELECT CAST(g."row" * 2 + i AS INT) AS "row", CAST(g.col * 2 + j AS INT) AS col, v FROM grid g, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""", needs=("grid",))
def resample_nearest(spark, d):
    return rs.upsample_nearest(grid(spark, d).select("row", "col", "v"), 2)


def _upsample_sql(weight: str, radius: int) -> str:
    k = f"(SELECT unnest(range({-radius}, {radius + 1})) AS k)"
    taps = f"(SELECT i, k, {weight} AS w FROM (SELECT i, k, abs((i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE - k) AS t FROM (SELECT unnest([0, 1]) AS i), {k}))"
    return f""", taps AS (SELECT * FROM {taps} WHERE abs(w) > 0.000000000001)
SELECT CAST(g."row" * 2 + g.ai AS INT) AS "row", CAST(g.col * 2 + g.bi AS INT) AS col, {rq('sum(s.v * g.aw * g.bw) / sum(g.aw * g.bw)', 2)} AS v
FROM (SELECT g."row", g.col, a.i AS ai, a.w AS aw, b.i AS bi, b.w AS bw, g."row" + a.k AS rr, g.col + b.k AS cc FROM grid g CROSS JOIN taps a CROSS JOIN taps b) g
JOIN grid s ON s."row" = g.rr AND s.col = g.cc GROUP BY 1, 2"""


def _upsampled(spark, d, kernel):
    g = grid(spark, d)
    return rounded(rs.upsample(g, "v", 2, kernel, focal.raster_extent(g), tile=TILE, dense=True), "v", digits=2)


@query("resample_bilinear", _upsample_sql("greatest(0, 1 - t)", 1), needs=("grid",))
def resample_bilinear(spark, d):
    return _upsampled(spark, d, "bilinear")


@query("resample_cubic", _upsample_sql("CASE WHEN t <= 1 THEN 1.5 * t * t * t - 2.5 * t * t + 1 WHEN t < 2 THEN -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2 ELSE 0 END", 2), needs=("grid",))
def resample_cubic(spark, d):
    return _upsampled(spark, d, "cubic")


# --------------------------------------------------------- any two grids

_FINE = 4.0  # target pixels: 2.5 to a source pixel, on an origin of their own
_SHIFT = (13.7123457, 21.3098761)
_ORIGIN = (AFFINE[2] + _SHIFT[0], AFFINE[5] - _SHIFT[1])
_PLACES = f""", tp AS (SELECT CAST(i // w AS INT) AS "row", CAST(i % w AS INT) AS col, ({_ORIGIN[1]!r}::DOUBLE + (i // w + 0.5::DOUBLE) * {-_FINE}::DOUBLE - 1200000.0::DOUBLE) / -10.0::DOUBLE AS py,
   ({_ORIGIN[0]!r}::DOUBLE + (i % w + 0.5::DOUBLE) * {_FINE}::DOUBLE - 600000.0::DOUBLE) / 10.0::DOUBLE AS px
 FROM (SELECT w, unnest(range(h * w)) AS i FROM (SELECT (max("row") + 1) * 5 // 2 - 9 AS h, (max(col) + 1) * 5 // 2 - 7 AS w FROM grid)))"""


def _warped(spark, d, method):
    g = grid(spark, d).withColumn("v", F.when(F.col("valid"), F.col("v")))
    extent = focal.raster_extent(g)
    affine = (_FINE, 0.0, _ORIGIN[0], 0.0, -_FINE, _ORIGIN[1])
    return rs.warp(g, ["v"], AFFINE, rs.Grid(affine, extent.rows * 5 // 2 - 9, extent.cols * 5 // 2 - 7), method, tile=64)


@query("warp_nearest", _PLACES + """SELECT tp."row", tp.col, CASE WHEN valid THEN v END AS v FROM tp JOIN grid g ON g."row" = floor(py) AND g.col = floor(px)""", needs=("grid",))
def warp_nearest(spark, d):
    return _warped(spark, d, "nearest")


def _warp_sql(weight: str, radius: int, digits: int) -> str:
    return _PLACES + f""", kk AS (SELECT unnest(range({1 - radius}, {radius + 1})) AS k),
 ys AS (SELECT "row", col, py, px, floor(py - 0.5::DOUBLE) + k AS r, {weight.format(t='abs(py - 0.5::DOUBLE - floor(py - 0.5::DOUBLE) - k)')} AS wy FROM tp, kk),
 xs AS (SELECT ys.*, floor(px - 0.5::DOUBLE) + k AS c, {weight.format(t='abs(px - 0.5::DOUBLE - floor(px - 0.5::DOUBLE) - k)')} AS wx FROM ys, kk)
SELECT xs."row", xs.col, {rq('sum(s.v * wy * wx) / sum(wy * wx)', digits)} AS v FROM xs JOIN grid o ON o."row" = floor(py) AND o.col = floor(px) LEFT JOIN grid s ON s."row" = r AND s.col = c AND s.valid WHERE s.v IS NOT NULL GROUP BY 1, 2"""


@query("warp_bilinear", _warp_sql("(1 - {t})", 1, 2), needs=("grid",))
def warp_bilinear(spark, d):
    return rounded(_warped(spark, d, "bilinear"), "v", digits=2)


_KEYS = "(CASE WHEN {t} <= 1 THEN 1.5 * pow({t}, 3) - 2.5 * pow({t}, 2) + 1 ELSE -0.5 * pow({t}, 3) + 2.5 * pow({t}, 2) - 4 * {t} + 2 END)"


@query("warp_cubic", _warp_sql(_KEYS, 2, 2), needs=("grid",))
def warp_cubic(spark, d):
    return rounded(_warped(spark, d, "cubic"), "v", digits=2)


_STEP, _LON, _LAT = 0.00009, 105.9135, 10.8545  # degrees


def _reproject_sql() -> str:
    east, north = geo.utm_sql()
    return f""", tp AS (SELECT CAST(i // 120 AS INT) AS "row", CAST(i % 120 AS INT) AS col, radians({_LON}::DOUBLE + (i % 120 + 0.5::DOUBLE) * {_STEP}::DOUBLE) - {geo._central_meridian(48)!r}::DOUBLE AS lam, radians({_LAT}::DOUBLE - (i // 120 + 0.5::DOUBLE) * {_STEP}::DOUBLE) AS phi
   FROM (SELECT unnest(range(120 * h)) AS i FROM (SELECT max("row") + 41 AS h FROM landcover))),
 tt AS (SELECT *, {geo.conformal_sql('phi')} AS t FROM tp),
 xe AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM tt),
 xy AS (SELECT "row", col, {east} AS x, {north} AS y FROM xe)
SELECT xy."row", xy.col, wc FROM xy JOIN landcover l ON l."row" = floor((y - 1200000) / -10) AND l.col = floor((x - 600000) / 10)"""


@query("reproject_labels", _reproject_sql(), needs=("landcover",))
def reproject_labels(spark, d):
    """Labels on a grid of degrees, read from their metric grid."""
    labels = landcover(spark, d)
    target = rs.Grid((_STEP, 0.0, _LON, 0.0, -_STEP, _LAT), focal.raster_extent(labels).rows + 40, 120)
    return rs.warp(labels, ["wc"], AFFINE, target, to_source=geo.lonlat_to_utm, tile=64)


# ------------------------------------------------------------------- focal

@query("majority_3x3", """SELECT "row", col, class FROM (SELECT a."row", a.col, b.class, row_number() OVER (PARTITION BY a."row", a.col ORDER BY count(*) DESC, b.class) AS rn
 FROM classes1 a JOIN classes1 b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3) WHERE rn = 1""", needs=("classes1",))
def majority_3x3(spark, d):
    c = classes(spark, d, 1)
    return focal.majority(c, focal.raster_extent(c), tile=TILE)


_GW = "exp(-0.5::DOUBLE * k * k)"
GAUSS = f""", k1 AS (SELECT k, {_GW} / (SELECT sum({_GW}) FROM (SELECT unnest(range(-4, 5)) AS k)) AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
 gt AS (SELECT a.k AS dy, b.k AS dx, a.w * b.w AS w FROM k1 a, k1 b)"""


@query("gaussian", D.format(t="grid") + GAUSS + stencil("grid", "v", "gt", rq("sum(s.v * t.w)", 2) + " AS v"), needs=("grid",))
def gaussian(spark, d):
    g = grid(spark, d)
    return rounded(focal.gaussian(g, "v", focal.raster_extent(g), tile=TILE, dense=True), "v", digits=2)


@query("convolve_laplace", D.format(t="grid") + ", lt AS (SELECT * FROM (VALUES (0, 0, -4.0::DOUBLE), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)) t(dy, dx, w))" + stencil("grid", "v", "lt", rq("sum(s.v * t.w)", 2) + " AS v"), needs=("grid",))
def convolve_laplace(spark, d):
    g = grid(spark, d)
    taps = [(0, 0, -4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]
    return rounded(focal.convolve(g, "v", taps, focal.raster_extent(g), tile=TILE, dense=True), "v", digits=2)


# the smoothed raster, invalid cells 0, and its 3 x 3 gradients
SMOOTH = D.format(t="grid") + GAUSS + """, clean AS (SELECT "row", col, CASE WHEN valid THEN CAST(v AS DOUBLE) ELSE 0 END AS v, valid FROM grid),
 sm AS (""" + stencil("clean", "v", "gt", "sum(s.v * t.w) AS v") + """),
 nine AS (SELECT CAST(y.k AS INT) AS dy, CAST(x.k AS INT) AS dx FROM (SELECT unnest(range(-1, 2)) AS k) y, (SELECT unnest(range(-1, 2)) AS k) x)"""


def _pick(dy, dx):
    return f"sum(CASE WHEN t.dy = {dy} AND t.dx = {dx} THEN s.v ELSE 0 END)"


_P9 = ", ".join(f"{_pick(dy, dx)} AS m{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
NINE = SMOOTH + ", n9 AS (" + stencil("sm", "v", "nine", _P9) + ")"
_GX = "((m02 - m00) + 2 * (m12 - m10) + (m22 - m20))"
_GY = "((m20 - m00) + 2 * (m21 - m01) + (m22 - m02))"
_PX = "((m02 - m00) + (m12 - m10) + (m22 - m20))"
_PY = "((m20 - m00) + (m21 - m01) + (m22 - m02))"


@query("edge_maps", NINE + f"""SELECT "row", col, {rq('sqrt(pow(m22 - m11, 2) + pow(m21 - m12, 2))', 2)} AS roberts, {rq(f'sqrt({_PX} * {_PX} + {_PY} * {_PY})', 2)} AS prewitt,
 {rq(f'sqrt({_GX} * {_GX} + {_GY} * {_GY})', 2)} AS sobel, {rq('abs(m01 + m21 + m10 + m12 - 4 * m11)', 2)} AS laplace FROM n9""", needs=("grid",))
def edge_maps(spark, d):
    g = grid(spark, d)
    return rounded(ed.edge_maps(g, "v", focal.raster_extent(g), tile=TILE, dense=True), *ed.OPERATORS, digits=2)


INTERIOR = """, dia AS (SELECT CAST(y.k AS INT) AS dy, CAST(x.k AS INT) AS dx FROM (SELECT unnest(range(-5, 6)) AS k) y, (SELECT unnest(range(-5, 6)) AS k) x WHERE abs(y.k) + abs(x.k) <= 5),
 inn AS (SELECT t."row", t.col, count(*) = 61 AS interior FROM (SELECT g."row", g.col, g."row" + dy AS rr, g.col + dx AS cc FROM grid g CROSS JOIN dia) t
   JOIN grid s ON s."row" = t.rr AND s.col = t.cc WHERE s.valid GROUP BY 1, 2)"""


@query("erosion5", INTERIOR + """SELECT g."row", g.col, coalesce(i.interior, false) AS valid FROM grid g LEFT JOIN inn i ON i."row" = g."row" AND i.col = g.col""", needs=("grid",))
def erosion5(spark, d):
    g = grid(spark, d)
    return focal.erode(g, "valid", focal.raster_extent(g), tile=TILE, dense=True)


@query("edge_density", D.format(t="classes1") + """, c49 AS (SELECT CAST(y.k AS INT) AS dy, CAST(x.k AS INT) AS dx FROM (SELECT unnest(range(-3, 4)) AS k) y, (SELECT unnest(range(-3, 4)) AS k) x)"""
       + stencil("classes1", "class", "c49", rq("sum(CASE WHEN s.class = 3 THEN 1 ELSE 0 END) / 49.0::DOUBLE") + " AS edge_density"), needs=("classes1",))
def edge_density(spark, d):
    c = classes(spark, d, 1)
    flags = c.select("row", "col", (F.col("class") == 3).cast("int").alias("edge"))
    return rounded(ed.edge_density(flags, focal.raster_extent(c), tile=TILE, dense=True), "edge_density")


_GX8, _GY8 = f"({_GX} / 8)", f"({_GY} / 8)"
NMS = NINE + INTERIOR + f""", mg AS (SELECT "row", col, {_GX8} AS gx, {_GY8} AS gy, sqrt({_GX8} * {_GX8} + {_GY8} * {_GY8}) AS v FROM n9),
 q9 AS ({stencil('mg', 'v', 'nine', _P9 + ', any_value(t.gx) AS gx, any_value(t.gy) AS gy')}),
 uu AS (SELECT *, gx / greatest(m11, 0.000000001) AS ux, gy / greatest(m11, 0.000000001) AS uy FROM q9),
 la AS (SELECT *, (1 - abs(uy)) * ((1 - abs(ux)) * m11 + abs(ux) * CASE WHEN ux > 0 THEN m12 ELSE m10 END) + abs(uy) * CASE WHEN uy > 0
      THEN (1 - abs(ux)) * m21 + abs(ux) * CASE WHEN ux > 0 THEN m22 ELSE m20 END ELSE (1 - abs(ux)) * m01 + abs(ux) * CASE WHEN ux > 0 THEN m02 ELSE m00 END END AS plus,
   (1 - abs(uy)) * ((1 - abs(ux)) * m11 + abs(ux) * CASE WHEN ux < 0 THEN m12 ELSE m10 END) + abs(uy) * CASE WHEN uy < 0
      THEN (1 - abs(ux)) * m21 + abs(ux) * CASE WHEN ux < 0 THEN m22 ELSE m20 END ELSE (1 - abs(ux)) * m01 + abs(ux) * CASE WHEN ux < 0 THEN m02 ELSE m00 END END AS minus FROM uu),
 nms AS (SELECT la."row", la.col, m11 AS v FROM la JOIN inn i ON la."row" = i."row" AND la.col = i.col WHERE i.interior AND m11 > plus AND m11 >= minus AND m11 > 0)"""


@query("nms", NMS + f"""SELECT "row", col, {rq('v', 2)} AS nms FROM nms""", needs=("grid",))
def nms(spark, d):
    g = grid(spark, d)
    out = ed.suppressed(g, "v", focal.raster_extent(g), tile=TILE, dense=True)
    return rounded(out.where("nms > 0").select("row", "col", "nms"), "nms", digits=2)


THRESHOLDS = ", lim AS (SELECT quantile_cont(v, 0.9) AS high, 0.4::DOUBLE * quantile_cont(v, 0.9) AS low FROM nms)"


@query("canny_thresholds", NMS + THRESHOLDS + f"SELECT {rq('low', 2)} AS low, {rq('high', 2)} AS high FROM lim", needs=("grid",))
def canny_thresholds(spark, d):
    g = grid(spark, d)
    return rounded(ed.canny(g, "v", focal.raster_extent(g), tile=TILE, dense=True)[1], "low", "high", digits=2)


def components_sql(fg: str) -> str:
    return """, fg AS MATERIALIZED (""" + fg + """), nb AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)),
 pairs AS MATERIALIZED (SELECT a.src, b.id AS dst FROM (SELECT id AS src, "row" + dy AS rr, col + dx AS cc FROM fg CROSS JOIN nb) a JOIN fg b ON b."row" = a.rr AND b.col = a.cc),
 reach(a, b) AS (SELECT id, id FROM fg UNION SELECT r.a, p.dst FROM reach r JOIN pairs p ON p.src = r.b),
 lab AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"""


CANNY = NMS + THRESHOLDS + components_sql("""SELECT n."row", n.col, CAST(n."row" * d.w + n.col AS BIGINT) AS id, n.v >= l.high AS strong FROM nms n, lim l, dims d WHERE n.v >= l.low""") + """,
 kept AS (SELECT component FROM lab JOIN fg ON fg.id = lab.id GROUP BY 1 HAVING count(*) >= 8 AND bool_or(strong)),
 edges AS (SELECT fg."row", fg.col FROM fg JOIN lab ON fg.id = lab.id JOIN kept ON kept.component = lab.component)"""


@query("canny", CANNY + """SELECT "row", col FROM edges""", needs=("grid",), recursive=True)
def canny(spark, d):
    g = grid(spark, d)
    return ed.canny(g, "v", focal.raster_extent(g), tile=TILE, dense=True)[0]


@query("edge_summary", CANNY + f"""SELECT count(*) AS valid_pixels, {rq('100.0::DOUBLE * avg(CASE WHEN e."row" IS NULL THEN 0 ELSE 1 END)')} AS edge_pct
 FROM grid g LEFT JOIN edges e ON g."row" = e."row" AND g.col = e.col WHERE g.valid""", needs=("grid",), recursive=True)
def edge_summary(spark, d):
    g = grid(spark, d)
    found, _ = ed.canny(g, "v", focal.raster_extent(g), tile=TILE, dense=True)
    valid = ed.edge_flags(g, found).where("valid")
    return rounded(valid.agg(F.count(F.lit(1)).alias("valid_pixels"), (100.0 * F.avg("edge")).alias("edge_pct")), "edge_pct")


_TEX = D.format(t="grid") + """, q AS (SELECT "row", col, CAST(least(7, greatest(0, CAST(trunc(v / 100000.0::DOUBLE / 0.5 * 8) AS INT))) AS INT) AS q FROM grid),
 off AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (-1, 1)) t(dy, dx)),
 pr AS (SELECT a."row", a.col, a.q AS i, b.q AS j FROM (SELECT q.*, ("row" + dy + h) % h AS rr, (col + dx + w) % w AS cc FROM q CROSS JOIN off CROSS JOIN dims) a JOIN q b ON b."row" = a.rr AND b.col = a.cc),
 c25 AS (SELECT CAST(y.k AS INT) AS dy, CAST(x.k AS INT) AS dx FROM (SELECT unnest(range(-2, 3)) AS k) y, (SELECT unnest(range(-2, 3)) AS k) x),
 pc AS (SELECT g."row", g.col, p.i, p.j, count(*) / 100.0::DOUBLE AS p FROM (SELECT g."row", g.col, """ + reflect('g."row" + t.dy', "d.h") + " AS rr, " + reflect("g.col + t.dx", "d.w") + """ AS cc
   FROM q g CROSS JOIN c25 t CROSS JOIN dims d) g JOIN pr p ON p."row" = g.rr AND p.col = g.cc GROUP BY 1, 2, 3, 4)"""


@query("glcm", _TEX + f"""SELECT "row", col, {rq('sum(p * (i - j) * (i - j))')} AS glcm_contrast, {rq('-sum(p * log2(p))')} AS glcm_entropy,
 {rq('sum(p / (1 + (i - j) * (i - j)))')} AS glcm_homogeneity, {rq('sum(p * abs(i - j))')} AS glcm_dissimilarity FROM pc GROUP BY 1, 2""", needs=("grid",))
def glcm(spark, d):
    g = grid(spark, d).select("row", "col", tx.quantise(F.col("v") / 100000.0).alias("q"))
    return rounded(tx.glcm(g, "q", focal.raster_extent(g), tile=TILE, dense=True), *cfg.TEXTURE_FEATURES)


@query("quantise", """SELECT CAST(least(7, greatest(0, CAST(trunc(v / 100000.0::DOUBLE / 0.5 * 8) AS INT))) AS INT) AS q, count(*) AS n, min(v) AS lo, max(v) AS hi FROM grid GROUP BY 1""", needs=("grid",))
def quantise(spark, d):
    g = grid(spark, d)
    return g.groupBy(tx.quantise(F.col("v") / 100000.0).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


_DENS = CANNY + D.format(t="grid").replace(", dims", ", dims2") + """, fl AS (SELECT g."row", g.col, CASE WHEN e."row" IS NULL THEN 0 ELSE 1 END AS edge, g.valid, g.v % 4 AS class FROM grid g LEFT JOIN edges e ON g."row" = e."row" AND g.col = e.col),
 c49 AS (SELECT CAST(y.k AS INT) AS dy, CAST(x.k AS INT) AS dx FROM (SELECT unnest(range(-3, 4)) AS k) y, (SELECT unnest(range(-3, 4)) AS k) x),
 den AS (""" + stencil("fl", "edge", "c49", "sum(s.edge) / 49.0::DOUBLE AS density") + f"""), sob AS (SELECT "row", col, sqrt({_GX} * {_GX} + {_GY} * {_GY}) / 8 AS g FROM n9),
 j AS (SELECT fl.class, den.density, sob.g FROM fl JOIN den ON fl."row" = den."row" AND fl.col = den.col JOIN sob ON sob."row" = fl."row" AND sob.col = fl.col WHERE fl.valid)"""


@query("density_by_class", _DENS + f"""SELECT CAST(class AS INT) AS class, ['Water', 'Vegetation', 'Bare Soil', 'Built-up'][CAST(class AS INT) + 1] AS class_name, count(*) AS n_pixels, {rq('avg(density)')} AS mean_edge_density,
 {rq('avg(g)', 2)} AS mean_sobel_gradient, {rq('(SELECT avg(density) FROM j WHERE class = 3) / (SELECT avg(density) FROM j WHERE class = 2)')} AS built_to_bare FROM j GROUP BY class""", needs=("grid",), recursive=True)
def density_by_class(spark, d):
    g = grid(spark, d)
    extent = focal.raster_extent(g)
    found, _ = ed.canny(g, "v", extent, tile=TILE, dense=True)
    density = ed.edge_density(ed.edge_flags(g, found), extent, tile=TILE, dense=True)
    sobel = ed.edge_maps(g, "v", extent, tile=TILE, dense=True).select("row", "col", (F.col("sobel") / 8).alias("sobel_gradient"))
    table = g.where("valid").select("row", "col", (F.col("v") % 4).alias("class")).join(density, ["row", "col"]).join(sobel, ["row", "col"])
    out = ed.density_by_class(table, by=())
    return rounded(rounded(out, "mean_edge_density", "built_to_bare"), "mean_sobel_gradient", digits=2)
