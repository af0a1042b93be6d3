"""Components, straight lines, vector features, distances, projection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import AFFINE, AOI, classes, grid, points, query, rd, rounded, rq, segments
from rasterloom.catalog.grids import TILE, components_sql
from rasterloom.catalog.scenes import _INSIDE
from rasterloom.functions import geo
from rasterloom.operators import components as co, focal, hough as ho, vectors as ve
from rasterloom.operators.polygons import EDGE, polygon_area, with_inside
from rasterloom.session import checkpoint

W = ", dims AS (SELECT max(col) + 1 AS w FROM classes1)"
LAB = W + components_sql("""SELECT c."row", c.col, CAST(c."row" * d.w + c.col AS BIGINT) AS id FROM classes1 c, dims d WHERE class = 3""")


def _built(spark, d):
    return classes(spark, d, 1).where(F.col("class") == cfg.BUILT_UP).select("row", "col")


def _labelled(spark, d):
    c = classes(spark, d, 1)
    return co.connected_components(_built(spark, d), focal.raster_extent(c), tile=TILE)


@query("components", LAB + """SELECT fg."row", fg.col, lab.component FROM fg JOIN lab ON fg.id = lab.id""", needs=("classes1",), recursive=True)
def components(spark, d):
    return _labelled(spark, d)


@query("component_sizes", LAB + """SELECT n AS size, count(*) AS components FROM (SELECT component, count(*) AS n FROM lab GROUP BY 1) WHERE n >= 8 GROUP BY 1""", needs=("classes1",), recursive=True)
def component_sizes(spark, d):
    sizes = co.component_sizes(_labelled(spark, d)).where("n >= 8")
    return sizes.groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("components"))


_AX = """, m AS (SELECT component, count(*) AS px, var_samp(CAST(col AS DOUBLE)) AS a, covar_samp(CAST(col AS DOUBLE), -CAST("row" AS DOUBLE)) AS b, var_samp(CAST("row" AS DOUBLE)) AS c
 FROM fg JOIN lab ON fg.id = lab.id GROUP BY 1), e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS big, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS small FROM m)"""


@query("largest_component_axis", LAB + _AX + f"""SELECT component, px, {rq('px * 0.01::DOUBLE')} AS ha, {rq('(450.0::DOUBLE - degrees(atan2(2 * b, a - c) / 2)) % 180')} AS bearing_deg,
 {rq('sqrt(big / greatest(small, 0.000000001))')} AS elongation, (SELECT count(*) FROM m) AS n_components FROM e ORDER BY px DESC, component LIMIT 1""", needs=("classes1",), recursive=True)
def largest_component_axis(spark, d):
    return rounded(co.largest_component(_labelled(spark, d)), "ha", "bearing_deg", "elongation")


ACC = """, acc AS (SELECT CAST(a.t AS INT) AS t, CAST(floor(round(p.col * cos(radians(a.t - 90.0::DOUBLE)) + p."row" * sin(radians(a.t - 90.0::DOUBLE)), 9) + 0.5::DOUBLE) AS INT) AS rho, count(*) AS n
 FROM (SELECT * FROM classes1 WHERE class = 3) p CROSS JOIN (SELECT unnest(range(180)) AS t) a GROUP BY 1, 2)"""


@query("hough_votes", ACC + "SELECT t, rho, n FROM acc", needs=("classes1",))
def hough_votes(spark, d):
    return ho.votes(_built(spark, d))


def _peaks_sql(n: int = 5) -> str:
    sql = ACC + """, strong AS MATERIALIZED (SELECT * FROM acc WHERE n > 0.5 * (SELECT max(n) FROM acc)),
 wrapped AS (SELECT t, rho, n FROM strong UNION ALL SELECT t + 180, -rho, n FROM strong WHERE t < 10 UNION ALL SELECT t - 180, -rho, n FROM strong WHERE t >= 170),
 c0 AS MATERIALIZED (SELECT s.* FROM strong s WHERE NOT EXISTS (SELECT 1 FROM wrapped o WHERE o.t BETWEEN s.t - 10 AND s.t + 10 AND o.rho BETWEEN s.rho - 9 AND s.rho + 9 AND o.n > s.n))"""
    for i in range(1, n + 1):
        sql += f""", b{i} AS MATERIALIZED (SELECT * FROM c{i - 1} ORDER BY n DESC, t, rho LIMIT 1),
 c{i} AS MATERIALIZED (SELECT c.* FROM c{i - 1} c, b{i} b WHERE NOT ((abs(c.t - b.t) <= 10 AND abs(c.rho - b.rho) <= 9) OR (180 - abs(c.t - b.t) <= 10 AND abs(c.rho + b.rho) <= 9)))"""
    rows = " UNION ALL ".join(f"SELECT *, CAST({i} AS INT) AS peak FROM b{i}" for i in range(1, n + 1))
    return sql + f", peaks AS ({rows})"


@query("hough_peaks", _peaks_sql() + f"SELECT peak, t, rho, n, {rq('CAST(t AS DOUBLE) % 180')} AS bearing_deg FROM peaks", needs=("classes1",))
def hough_peaks(spark, d):
    return rounded(ho.peaks(ho.votes(_built(spark, d))), "bearing_deg")


SEGS = """, onl AS (SELECT p.peak, e."row", e.col, round(e."row" * cos(radians(p.t - 90.0::DOUBLE)) - e.col * sin(radians(p.t - 90.0::DOUBLE)), 6) AS pos FROM (SELECT * FROM classes1 WHERE class = 3) e, peaks p
   WHERE abs(e.col * cos(radians(p.t - 90.0::DOUBLE)) + e."row" * sin(radians(p.t - 90.0::DOUBLE)) - p.rho) <= 1.0),
 st AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY peak ORDER BY pos, "row", col) > 3 THEN 1 ELSE 0 END AS nw FROM onl),
 rn AS (SELECT *, sum(nw) OVER (PARTITION BY peak ORDER BY pos, "row", col ROWS UNBOUNDED PRECEDING) AS run FROM st),
 sg AS (SELECT peak, run, count(*) AS n_px, min({'p': pos, 'r': "row", 'c': col}) AS a, max({'p': pos, 'r': "row", 'c': col}) AS b FROM rn GROUP BY 1, 2),
 seg AS (SELECT peak, a.r AS row1, a.c AS col1, b.r AS row2, b.c AS col2, n_px, sqrt(pow(b.c - a.c, 2) + pow(b.r - a.r, 2)) * 10 AS length_m,
   (degrees(atan2(CAST(b.c - a.c AS DOUBLE), -CAST(b.r - a.r AS DOUBLE))) + 360) % 180 AS bearing_deg FROM sg WHERE b.p - a.p >= 10)"""


def _segments(spark, d):
    built = _built(spark, d)
    lines = checkpoint(ho.peaks(ho.votes(built)))
    return ho.segments(built, lines, min_length=10, gap=3)


@query("line_segments", _peaks_sql() + SEGS + f"""SELECT peak, row1, col1, row2, col2, n_px, {rq('length_m', 4)} AS length_m, {rq('bearing_deg', 4)} AS bearing_deg FROM seg""", needs=("classes1",))
def line_segments(spark, d):
    return rounded(_segments(spark, d), "length_m", "bearing_deg", digits=4)


_RUNS = """, px AS (SELECT e."row", e.col, q.t, radians(q.t - 90.0::DOUBLE) AS th FROM (SELECT * FROM classes1 WHERE class = 3) e CROSS JOIN (SELECT CAST(unnest(range(180)) AS INT) AS t) q),
 pr AS (SELECT "row", col, t, round("row" * cos(th) - col * sin(th), 6) AS pos, CAST(unnest(range(CAST(ceil(round(col * cos(th) + "row" * sin(th) - 1, 9)) AS INT), CAST(floor(round(col * cos(th) + "row" * sin(th) + 1, 9)) AS INT) + 1)) AS INT) AS rho FROM px),
 st AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY t, rho ORDER BY pos, "row", col) > 3 THEN 1 ELSE 0 END AS nw FROM pr),
 rn AS (SELECT *, sum(nw) OVER (PARTITION BY t, rho ORDER BY pos, "row", col ROWS UNBOUNDED PRECEDING) AS run FROM st),
 sg AS (SELECT t, rho, run, count(*) AS n_px, min({'p': pos, 'r': "row", 'c': col}) AS a, max({'p': pos, 'r': "row", 'c': col}) AS b FROM rn GROUP BY 1, 2, 3),
 lg AS (SELECT *, round(b.p - a.p, 6) AS len FROM sg WHERE round(b.p - a.p, 6) >= 10),
 ow AS (SELECT rn."row", rn.col, lg.t, lg.rho, lg.run, row_number() OVER (PARTITION BY rn."row", rn.col ORDER BY len DESC, n_px DESC, lg.t, lg.rho, lg.run) AS k FROM rn JOIN lg ON rn.t = lg.t AND rn.rho = lg.rho AND rn.run = lg.run),
 ct AS (SELECT t, rho, run, count(*) AS own FROM ow WHERE k = 1 GROUP BY 1, 2, 3)"""
_ALL = _RUNS + """
SELECT lg.t, lg.rho, a.r AS row1, a.c AS col1, b.r AS row2, b.c AS col2, n_px FROM lg JOIN ct ON lg.t = ct.t AND lg.rho = ct.rho AND lg.run = ct.run WHERE 2 * own >= n_px"""


@query("all_line_segments", _ALL, needs=("classes1",))
def all_line_segments(spark, d):
    """Runs along every line with enough votes, not only the strongest."""
    return ho.all_segments(_built(spark, d), min_length=10, gap=3).select("t", "rho", "row1", "col1", "row2", "col2", "n_px")


def _all_segments(spark, d):
    segs = ho.all_segments(_built(spark, d), min_length=10, gap=3)
    return checkpoint(segs.withColumn("seg", F.concat_ws("-", "t", "rho", "row1", "col1", "row2", "col2")))


def _grouped(spark, d):
    segs = _all_segments(spark, d).withColumn("year", F.lit(2022))
    rated = ho.hit_rate(segs, classes(spark, d, 1).withColumn("year", F.lit(2022)))
    return ho.group_segments(rated)


@query("hit_rate", _peaks_sql() + SEGS + """, sid AS (SELECT *, greatest(CAST(floor(length_m / 10) AS INT), 2) AS np FROM seg),
 pt AS (SELECT peak, row1, col1, row2, col2, i, np, CAST(trunc(row1 + (row2 - row1) * (i / (np - 1)::DOUBLE)) AS INT) AS r, CAST(trunc(col1 + (col2 - col1) * (i / (np - 1)::DOUBLE)) AS INT) AS c FROM (SELECT *, unnest(range(np)) AS i FROM sid)),
 hit AS (SELECT p.peak, p.row1, p.col1, p.row2, p.col2, count(DISTINCT i) AS hits FROM (SELECT pt.*, r + dy AS rr, c + dx AS cc FROM pt CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx)) p
   JOIN classes1 k ON k."row" = p.rr AND k.col = p.cc WHERE k.class = 3 GROUP BY 1, 2, 3, 4, 5)
SELECT s.peak, s.row1, s.col1, s.row2, s.col2, round(100.0::DOUBLE * coalesce(h.hits, 0) / s.np, 1) AS builtup_pct FROM sid s LEFT JOIN hit h
 ON s.peak = h.peak AND s.row1 = h.row1 AND s.col1 = h.col1 AND s.row2 = h.row2 AND s.col2 = h.col2""", needs=("classes1",))
def hit_rate(spark, d):
    segs = checkpoint(_segments(spark, d).withColumn("seg", F.concat_ws("-", "peak", "row1", "col1", "row2", "col2")))
    rated = ho.hit_rate(segs, classes(spark, d, 1), keys=[])
    return rated.select("peak", "row1", "col1", "row2", "col2", "builtup_pct")


_SEG = ["t", "rho", "row1", "col1", "row2", "col2"]
_RATED = _RUNS + """, sid AS (SELECT *, greatest(CAST(floor(length_m / 10) AS INT), 2) AS np FROM (SELECT lg.t, lg.rho, a.r AS row1, a.c AS col1, b.r AS row2, b.c AS col2, sqrt(pow(b.c - a.c, 2) + pow(b.r - a.r, 2)) * 10 AS length_m
   FROM lg JOIN ct ON lg.t = ct.t AND lg.rho = ct.rho AND lg.run = ct.run WHERE 2 * own >= n_px)),
 pt AS (SELECT *, CAST(trunc(row1 + (row2 - row1) * (i / (np - 1)::DOUBLE)) AS INT) AS r, CAST(trunc(col1 + (col2 - col1) * (i / (np - 1)::DOUBLE)) AS INT) AS c FROM (SELECT *, unnest(range(np)) AS i FROM sid)),
 hit AS (SELECT t, rho, row1, col1, row2, col2, count(DISTINCT i) AS hits FROM (SELECT pt.*, r + dy AS rr, c + dx AS cc FROM pt CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx)) p
   JOIN classes1 k ON k."row" = p.rr AND k.col = p.cc WHERE k.class = 3 GROUP BY 1, 2, 3, 4, 5, 6),
 rated AS (SELECT s.t, s.rho, s.row1, s.col1, s.row2, s.col2, length_m, (degrees(atan2(CAST(s.col2 - s.col1 AS DOUBLE), -CAST(s.row2 - s.row1 AS DOUBLE))) + 360) % 180 AS bearing_deg, round(100.0::DOUBLE * coalesce(h.hits, 0) / s.np, 1) AS builtup_pct FROM sid s LEFT JOIN hit h
 ON s.t = h.t AND s.rho = h.rho AND s.row1 = h.row1 AND s.col1 = h.col1 AND s.row2 = h.row2 AND s.col2 = h.col2)"""


@query("hit_rate_all_lines", ACC + _RATED + "SELECT t, rho, row1, col1, row2, col2, builtup_pct FROM rated", needs=("classes1",))
def hit_rate_all_lines(spark, d):
    """As hit_rate, for the runs along every line."""
    return ho.hit_rate(_all_segments(spark, d), classes(spark, d, 1), keys=[]).select(*_SEG, "builtup_pct")


#: The greedy rule, one cell of bearing and length for each step.
_GROUPS = f""", placed AS (SELECT *, CAST(floor(round(bearing_deg / {ho.BEARING_BIN}::DOUBLE, 6)) AS INT) AS bin, CAST(floor(round(log2(length_m) * {ho.LENGTH_CLASSES}, 6)) AS INT) AS cls FROM rated),
 cell AS (SELECT *, wb / w AS b, row_number() OVER (ORDER BY longest DESC, bin) AS k FROM (SELECT bin, cls, round(max(length_m), 6) AS longest, sum(length_m) AS w, sum(bearing_deg * length_m) AS wb FROM placed GROUP BY 1, 2)),
 walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(b DOUBLE, w DOUBLE, wb DOUBLE)[]) AS g, CAST(0 AS BIGINT) AS pos
  UNION ALL SELECT k, CASE WHEN hit = 0 THEN list_append(g, {{'b': b, 'w': w, 'wb': wb}}) ELSE g[:hit - 1] || [{{'b': (g[hit].wb + wb) / (g[hit].w + w), 'w': g[hit].w + w, 'wb': g[hit].wb + wb}}] || g[hit + 1:] END,
   CASE WHEN hit = 0 THEN len(g) + 1 ELSE hit END FROM (SELECT c.k, c.b, c.w, c.wb, v.g,
    CAST(coalesce(list_position(list_transform(v.g, lambda x: round(least(abs(c.b - x.b), 180 - abs(c.b - x.b)), 9) <= {cfg.ANGLE_TOLERANCE_DEG}), true), 0) AS BIGINT) AS hit FROM walk v JOIN cell c ON c.k = v.k + 1)),
 grp AS (SELECT pos, q.b AS b, q.w AS w, CAST(row_number() OVER (ORDER BY round(q.w, 6) DESC, pos) AS INT) AS num FROM (SELECT unnest(g) AS q, CAST(unnest(range(len(g))) + 1 AS BIGINT) AS pos FROM (SELECT g FROM walk ORDER BY k DESC LIMIT 1))),
 named AS (SELECT p.*, grp.num, grp.b AS group_b, grp.w AS group_w FROM placed p JOIN cell c ON c.bin = p.bin AND c.cls = p.cls JOIN walk ON walk.k = c.k JOIN grp ON grp.pos = walk.pos)"""


@query("segment_groups", ACC + _RATED + _GROUPS + f"""SELECT CAST(2022 AS INT) AS "year", num AS "group", t, rho, row1, col1, row2, col2, {rq('bearing_deg', 2)} AS bearing_deg, {rq('length_m', 2)} AS length_m,
 builtup_pct, {rq('group_w', 2)} AS group_total_len_m FROM named""", needs=("classes1",), recursive=True)
def segment_groups(spark, d):
    g = _grouped(spark, d)
    return rounded(g.select("year", "group", *_SEG, "bearing_deg", "length_m", "builtup_pct", "group_total_len_m"),
                   "bearing_deg", "length_m", "group_total_len_m", digits=2)


_GAP = "abs(dominant_bearing_deg - axis_bearing_deg)"


@query("line_summary", LAB + _AX + _peaks_sql() + _RATED + _GROUPS + f""", axis AS (SELECT (450.0::DOUBLE - degrees(atan2(2 * b, a - c) / 2)) % 180 AS axis_bearing_deg FROM e ORDER BY px DESC, component LIMIT 1),
 su AS (SELECT count(*) AS n_segments, coalesce(max(num), 0) AS n_groups, {rq('max(CASE WHEN num = 1 THEN group_b END)', 2)} AS dominant_bearing_deg,
  {rq('coalesce(max(CASE WHEN num = 1 THEN group_w END), 0)', 1)} AS dominant_total_len_m, {rq('coalesce(max(CASE WHEN num = 1 THEN length_m END), 0)', 1)} AS dominant_max_len_m, count_if(num = 1) AS dominant_n_segments,
  {rq('coalesce(sum(CASE WHEN num = 1 THEN builtup_pct * length_m END) / greatest(max(CASE WHEN num = 1 THEN group_w END), 0.000000001::DOUBLE), 0)', 1)} AS dominant_builtup_pct,
  {rq('coalesce(max(length_m), 0)', 1)} AS longest_single_segment_m FROM named)
SELECT CAST(2022 AS INT) AS "year", CAST(n_segments AS BIGINT) AS n_segments, n_groups, dominant_bearing_deg, dominant_total_len_m, dominant_max_len_m, CAST(dominant_n_segments AS BIGINT) AS dominant_n_segments, dominant_builtup_pct, longest_single_segment_m,
 (SELECT count(*) FROM classes1 WHERE class = 3) AS edge_px, coalesce((SELECT string_agg(CAST(CAST(t % 180 AS INT) AS VARCHAR), ',' ORDER BY peak) FROM peaks), '') AS peak_bearings,
 {rq('axis_bearing_deg')} AS axis_bearing_deg, {rq(f'least({_GAP}, 180 - {_GAP})', 2)} AS bearing_gap_deg FROM su LEFT JOIN axis ON true""", needs=("classes1",), recursive=True)
def line_summary(spark, d):
    """Lines of a year against the largest built-up component."""
    year = F.lit(2022)
    built = _built(spark, d).withColumn("year", year)
    peaks = ho.peaks(checkpoint(ho.votes(built, ["year"])), ["year"])
    summary = ho.line_summary(_grouped(spark, d), layers=classes(spark, d, 1).select(year.alias("year")), edges=built, peaks=peaks)
    axis = co.largest_component(_labelled(spark, d)).withColumn("year", year)
    whole = F.array_join(F.transform("peak_bearings_deg", lambda b: b.cast("int").cast("string")), ",")
    gap = ho.bearing_gap(summary, axis).withColumn("peak_bearings", whole).drop("peak_bearings_deg")
    return rounded(gap, "axis_bearing_deg", "dominant_builtup_pct")


# ---------------------------------------------------------------- vectors

@query("feature_filter", """SELECT fid, highway FROM segments WHERE highway IN ('motorway', 'trunk', 'primary', 'secondary') AND regexp_matches(coalesce(name, ''), '(?i)machin|build')
 AND least(x1, x2) <= 600700 AND greatest(x1, x2) >= 600200 AND least(y1, y2) <= 1199800 AND greatest(y1, y2) >= 1199000""", needs=("segments",))
def feature_filter(spark, d):
    feats = ve.with_envelope(segments(spark, d))
    return ve.filter_features(feats, (600200, 1199000, 600700, 1199800), cfg.ROAD_CLASSES, "machin|build").select("fid", "highway")


@query("feature_names", """SELECT DISTINCT coalesce(nullif(name, ''), '(unnamed)') AS name FROM segments""", needs=("segments",))
def feature_names(spark, d):
    return segments(spark, d).select(ve.feature_name().alias("name")).distinct().orderBy("name")


_RING_EDGES = ", ".join(
    f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)"
    for ring in AOI for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
)
_CUT = f""", e AS (SELECT * FROM (VALUES {_RING_EDGES}) v(ex1, ey1, ex2, ey2)),
 cr AS (SELECT fid, t FROM (SELECT s.fid, ((ex1 - x1) * (ey2 - ey1) - (ey1 - y1) * (ex2 - ex1)) / nullif((x2 - x1) * (ey2 - ey1) - (y2 - y1) * (ex2 - ex1), 0) AS t,
    ((ex1 - x1) * (y2 - y1) - (ey1 - y1) * (x2 - x1)) / nullif((x2 - x1) * (ey2 - ey1) - (y2 - y1) * (ex2 - ex1), 0) AS u FROM segments s CROSS JOIN e) WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1
  UNION SELECT fid, 0.0::DOUBLE FROM segments UNION SELECT fid, 1.0::DOUBLE FROM segments),
 sp AS (SELECT fid, t AS a, lead(t) OVER (PARTITION BY fid ORDER BY t) AS b FROM cr),
 md AS (SELECT s.fid, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) * (b - a) AS len, x1 + (x2 - x1) * (a + b) / 2 AS x, y1 + (y2 - y1) * (a + b) / 2 AS y FROM sp JOIN segments s ON s.fid = sp.fid WHERE b IS NOT NULL),
 io AS (SELECT fid, len, {_INSIDE} AS inside FROM md)"""


@query("clip_lines", _CUT + f"""SELECT fid, count(*) AS parts, {rq('sum(len)', 4)} AS length_m FROM io WHERE NOT inside GROUP BY 1""", needs=("segments",))
def clip_lines(spark, d):
    out = ve.clip_segments(segments(spark, d), AOI, "outside")
    return rounded(out.groupBy("fid").agg(F.count(F.lit(1)).alias("parts"), F.sum("length_m").alias("length_m")), "length_m", digits=4)


@query("line_length_inside", _CUT + f"""SELECT {rq('sum(len)', 4)} AS inside_m FROM io WHERE inside""", needs=("segments",))
def line_length_inside(spark, d):
    return rounded(ve.length_inside(segments(spark, d), AOI), "inside_m", digits=4)


#: Triangles of the segments, each with its half as a hole.
_HOLED = """holed AS (SELECT fid, 0.75::DOUBLE * abs((x2 - x1) * (-61 - fid % 30) - (y2 - y1) * (37 + fid % 50)) / 2 AS area FROM segments WHERE abs((x2 - x1) * (-61 - fid % 30) - (y2 - y1) * (37 + fid % 50)) > 1)
"""


def _holed(spark, d):
    ring = F.col("coords")
    def hole(p):
        return F.struct(((p["x"] + ring[0]["x"]) / 2).alias("x"), ((p["y"] + ring[0]["y"]) / 2).alias("y"))
    return _triangles(spark, d).select("fid", F.array(ring, F.transform(ring, hole)).alias("rings"))


@query("polygon_areas", ", " + _HOLED + f"SELECT fid, {rq('area', 2)} AS area_m2 FROM holed", needs=("segments",))
def polygon_areas(spark, d):
    """Areas without holes."""
    return _holed(spark, d).select("fid", rd(polygon_area(F.col("rings")), 2).alias("area_m2"))


@query("feature_totals", _CUT + ", " + _HOLED + f"""SELECT (SELECT count(DISTINCT fid) FROM segments) AS n_features, {rq('(SELECT sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) FROM segments)', 4)} AS total_length_m,
 {rq('(SELECT sum(len) FROM io WHERE inside)', 4)} AS inside_m, (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT DISTINCT coalesce(name, '(unnamed)') AS name FROM segments)) AS names,
 {rq('(SELECT sum(area) FROM holed)', 2)} AS polygon_area_m2""", needs=("segments",))
def feature_totals(spark, d):
    out = rounded(ve.feature_totals(segments(spark, d), AOI, _holed(spark, d)), "polygon_area_m2", digits=2).withColumn("names", F.concat_ws("|", "names"))
    return rounded(out, "total_length_m", "inside_m", digits=4)


_BOX = [[(600000.0, 1200000.0), (601000.0, 1200000.0), (601000.0, 1198600.0), (600000.0, 1198600.0)]]


def _clip_sql(p: str, source: str, rings, inside: str) -> str:
    """Tables {p}e, {p}cr, {p}sp, {p}io: parts of the lines of `source` (k, fid, x1, y1, x2, y2) and their side."""
    edges = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]))
    return f"""{p}e AS (SELECT * FROM (VALUES {edges}) v(ex1, ey1, ex2, ey2)),
 {p}cr AS (SELECT k, t FROM (SELECT s.k, ((ex1 - x1) * (ey2 - ey1) - (ey1 - y1) * (ex2 - ex1)) / nullif((x2 - x1) * (ey2 - ey1) - (y2 - y1) * (ex2 - ex1), 0) AS t,
    ((ex1 - x1) * (y2 - y1) - (ey1 - y1) * (x2 - x1)) / nullif((x2 - x1) * (ey2 - ey1) - (y2 - y1) * (ex2 - ex1), 0) AS u FROM {source} s CROSS JOIN {p}e) WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1
  UNION SELECT k, 0.0::DOUBLE FROM {source} UNION SELECT k, 1.0::DOUBLE FROM {source}),
 {p}sp AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS b FROM {p}cr),
 {p}md AS (SELECT s.k, fid, a, x1, y1, x2, y2, b, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) * (b - a) AS len, x1 + (x2 - x1) * (a + b) / 2 AS x, y1 + (y2 - y1) * (a + b) / 2 AS y FROM {p}sp sp JOIN {source} s ON s.k = sp.k WHERE b IS NOT NULL),
 {p}io AS (SELECT k || '/' || a AS k, fid, x1 + (x2 - x1) * a AS x1, y1 + (y2 - y1) * a AS y1, x1 + (x2 - x1) * b AS x2, y1 + (y2 - y1) * b AS y2, len, {inside} AS inside FROM {p}md)"""


_FEATURES = ", src AS (SELECT CAST(fid AS VARCHAR) AS k, fid, x1, y1, x2, y2 FROM segments), " + _clip_sql(
    "b", "src", _BOX, "(x > 600000 AND x < 601000 AND y > 1198600 AND y < 1200000)") + ", nr AS (SELECT * FROM bio WHERE inside), " + _clip_sql("f", "nr", AOI, _INSIDE)


@query("clip_features", _FEATURES + f"""SELECT kp.fid, {rq('kept_m', 4)} AS kept_m, {rq('removed_m', 4)} AS removed_m FROM (SELECT fid, sum(len) AS kept_m FROM fio WHERE NOT inside GROUP BY 1 HAVING sum(len) >= 5) kp
 LEFT JOIN (SELECT fid, sum(len) AS removed_m FROM fio WHERE inside GROUP BY 1) rm ON rm.fid = kp.fid""", needs=("segments",))
def clip_features(spark, d):
    """Roads near a box, outside the fence, both polygons as edge tables."""
    box, fence = (spark.createDataFrame(geo.polygon_edges(r), EDGE) for r in (_BOX, AOI))
    kept, removed = ve.clip_features(segments(spark, d), box, fence)
    total = kept.groupBy("fid").agg(F.sum("length_m").alias("kept_m"))
    return rounded(total.join(removed, "fid", "left"), "kept_m", "removed_m", digits=4)


@query("points_in_polygons", f"""SELECT point_id, {_INSIDE} AS inside FROM points""", needs=("points",))
def points_in_polygons(spark, d):
    """Side of every point by tiles, for a polygon that is an edge table."""
    fence = spark.createDataFrame(geo.polygon_edges(AOI), EDGE)
    return with_inside(points(spark, d), fence, ["point_id"], size=200.0).select("point_id", "inside")


@query("near_box", """SELECT fid FROM segments WHERE sqrt(pow(greatest(600300 - x1, x1 - 600600, 0), 2) + pow(greatest(1199200 - y1, y1 - 1199600, 0), 2)) <= 150""", needs=("segments",))
def near_box(spark, d):
    box = (600300.0, 1199200.0, 600600.0, 1199600.0)
    return segments(spark, d).where(ve.near_box(F.col("x1"), F.col("y1"), box, 150.0)).select("fid")


_CELLS = """, uv AS (SELECT fid, (x1 - 600000.0::DOUBLE) / 10.0::DOUBLE AS u1, (x2 - 600000.0::DOUBLE) / 10.0::DOUBLE AS u2, (y1 - 1200000.0::DOUBLE) / -10.0::DOUBLE AS v1, (y2 - 1200000.0::DOUBLE) / -10.0::DOUBLE AS v2
   FROM segments WHERE highway IN ('motorway', 'trunk', 'primary', 'secondary')),
 crossing AS (SELECT fid, 0.0::DOUBLE AS t FROM uv UNION ALL SELECT fid, 1.0::DOUBLE FROM uv
  UNION ALL SELECT fid, (i - u1) / (u2 - u1) FROM (SELECT *, unnest(range(CAST(floor(least(u1, u2)) AS BIGINT) + 1, CAST(ceil(greatest(u1, u2)) AS BIGINT))) AS i FROM uv)
  UNION ALL SELECT fid, (i - v1) / (v2 - v1) FROM (SELECT *, unnest(range(CAST(floor(least(v1, v2)) AS BIGINT) + 1, CAST(ceil(greatest(v1, v2)) AS BIGINT))) AS i FROM uv)),
 middle AS (SELECT fid, (t + after) / 2 AS m FROM (SELECT fid, t, lead(t) OVER (PARTITION BY fid ORDER BY t) AS after FROM crossing) WHERE after - t > 0.000000001::DOUBLE
  UNION ALL SELECT fid, t FROM crossing WHERE t IN (0, 1)),
 cells AS (SELECT DISTINCT CAST(floor(v1 + (v2 - v1) * m) AS INT) AS "row", CAST(floor(u1 + (u2 - u1) * m) AS INT) AS col FROM middle JOIN uv ON uv.fid = middle.fid)"""


def _cells(spark, d):
    roads = ve.filter_features(segments(spark, d), highway=cfg.ROAD_CLASSES)
    return ve.rasterize_lines(roads, AFFINE)


@query("rasterize_lines", _CELLS + """SELECT "row", col FROM cells""", needs=("segments",))
def rasterize_lines(spark, d):
    return _cells(spark, d)


_DIST = _CELLS + """, near AS (SELECT g."row", g.col, min(sqrt(pow(g."row" - c."row", 2) + pow(g.col - c.col, 2)) * 10) AS distance FROM grid g CROSS JOIN cells c GROUP BY 1, 2)"""


def _distance(spark, d):
    g = grid(spark, d)
    return ve.nearest_distance(g, _cells(spark, d), focal.raster_extent(g))


@query("road_distance", _DIST + f"""SELECT "row", col, {rq('distance')} AS distance FROM near""", needs=("grid", "segments"))
def road_distance(spark, d):
    return rounded(_distance(spark, d).select("row", "col", "distance"), "distance")


@query("road_distance_bands", _DIST + f""", z AS (SELECT g.v % 4 AS class, CASE WHEN distance < 20 THEN '0-20' WHEN distance < 50 THEN '20-50' WHEN distance < 100 THEN '50-100' WHEN distance < 200 THEN '100-200' ELSE '200-inf' END AS band FROM near JOIN grid g ON g."row" = near."row" AND g.col = near.col)
SELECT CAST(2022 AS INT) AS "year", b.band, {rq('count(z.class) * 0.01::DOUBLE')} AS zone_ha, {rq('count(CASE WHEN z.class = 3 THEN 1 END) * 0.01::DOUBLE')} AS builtup_ha,
 {rq('coalesce(100.0::DOUBLE * count(CASE WHEN z.class = 3 THEN 1 END) / nullif(count(z.class), 0), 0)')} AS builtup_pct FROM (SELECT unnest(['0-20', '20-50', '50-100', '100-200', '200-inf']) AS band) b LEFT JOIN z ON z.band = b.band GROUP BY b.band""", needs=("grid", "segments"))
def road_distance_bands(spark, d):
    from rasterloom.operators.zones import distance_band_table

    table = _distance(spark, d).withColumns({"year": F.lit(2022), "class": F.col("v") % 4})
    return rounded(distance_band_table(table, "distance", 0.01, [0, 20, 50, 100, 200]), "zone_ha", "builtup_ha", "builtup_pct")


@query("rasterize_polygon", f""", xy AS (SELECT *, 600000.0::DOUBLE + (col + 0.5::DOUBLE) * 10.0::DOUBLE AS x, 1200000.0::DOUBLE - ("row" + 0.5::DOUBLE) * 10.0::DOUBLE AS y FROM grid)
SELECT "row", col, v FROM xy WHERE {_INSIDE}""", needs=("grid",))
def rasterize_polygon(spark, d):
    """The join path for polygons too large for a literal."""
    from rasterloom.operators.polygons import rasterize_polygon as fill

    edges = spark.createDataFrame(geo.polygon_edges(AOI), "x1 double, y1 double, x2 double, y2 double")
    return grid(spark, d).join(fill(edges, AFFINE), ["row", "col"], "left_semi").select("row", "col", "v")


_TRI = """, tri AS (SELECT fid, [x1, x2, x1 + 37 + fid % 50] AS xs, [y1, y2, y1 - 61 - fid % 30] AS ys FROM segments WHERE abs((x2 - x1) * (-61 - fid % 30) - (y2 - y1) * (37 + fid % 50)) > 1),
 ed AS (SELECT *, CAST(k % 3 + 1 AS INT) AS b FROM (SELECT *, unnest([1, 2, 3]) AS k FROM tri)), dr AS (SELECT *, (xs[b] - xs[k]) AS ux, (ys[b] - ys[k]) AS uy FROM ed),
 ex AS (SELECT fid, (greatest(xs[1] * ux + ys[1] * uy, xs[2] * ux + ys[2] * uy, xs[3] * ux + ys[3] * uy) - least(xs[1] * ux + ys[1] * uy, xs[2] * ux + ys[2] * uy, xs[3] * ux + ys[3] * uy))
   * (greatest(-xs[1] * uy + ys[1] * ux, -xs[2] * uy + ys[2] * ux, -xs[3] * uy + ys[3] * ux) - least(-xs[1] * uy + ys[1] * ux, -xs[2] * uy + ys[2] * ux, -xs[3] * uy + ys[3] * ux)) / (ux * ux + uy * uy) AS area FROM dr WHERE ux <> 0 OR uy <> 0)"""


def _triangles(spark, d):
    c = F.col
    third_x, third_y = c("x1") + 37 + c("fid") % 50, c("y1") - 61 - c("fid") % 30
    solid = F.abs((c("x2") - c("x1")) * (-61 - c("fid") % 30) - (c("y2") - c("y1")) * (37 + c("fid") % 50)) > 1
    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))
    return segments(spark, d).where(solid).select(
        "fid", F.array(pt(c("x1"), c("y1")), pt(c("x2"), c("y2")), pt(third_x, third_y), pt(c("x1"), c("y1"))).alias("coords"))


@query("min_rotated_rect", _TRI + f"SELECT fid, {rq('min(area)', 2)} AS area_m2 FROM ex GROUP BY 1", needs=("segments",))
def min_rotated_rect(spark, d):
    boxes = ve.principal_axis(_triangles(spark, d))
    return boxes.select("fid", rd(F.col("length") * F.col("width"), 2).alias("area_m2"))


@query("ring_area", _TRI + f"SELECT fid, {rq('abs((xs[2] - xs[1]) * (ys[3] - ys[1]) - (xs[3] - xs[1]) * (ys[2] - ys[1])) / 2', 2)} AS area_m2 FROM tri", needs=("segments",))
def ring_area(spark, d):
    return _triangles(spark, d).select("fid", rd(ve.ring_area(F.col("coords")), 2).alias("area_m2"))


@query("line_explode", _TRI + """SELECT fid, k AS seg, xs[k + 1] AS x1, ys[k + 1] AS y1, xs[(k + 1) % 3 + 1] AS x2, ys[(k + 1) % 3 + 1] AS y2 FROM (SELECT *, CAST(unnest([0, 1, 2]) AS INT) AS k FROM tri)""", needs=("segments",))
def line_explode(spark, d):
    return ve.line_segments(_triangles(spark, d))


def _utm_sql() -> str:
    n, radius, alpha, _, _ = geo._series()
    e = 2 * math.sqrt(n) / (1 + n)
    k = geo.UTM_K0 * radius
    terms_x = "eta" + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    terms_y = "xi" + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f""", ll AS (SELECT point_id, radians(106.9::DOUBLE + (x - 600000) / 5000) AS lam, radians(10.7::DOUBLE + (1200000 - y) / 12000) AS phi FROM points),
 tt AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t, lam - {geo._central_meridian(48)!r}::DOUBLE AS dl FROM ll),
 xe AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM tt)
SELECT point_id, {rq(f'500000.0::DOUBLE + {k!r}::DOUBLE * ({terms_x})', 3)} AS x, {rq(f'{k!r}::DOUBLE * ({terms_y})', 3)} AS y, {rq('degrees(lam)', 7)} AS lon, {rq('degrees(phi)', 7)} AS lat FROM xe"""


@query("utm_project", _utm_sql(), needs=("points",))
def utm_project(spark, d):
    """Forward projection, and back again to the same coordinates."""
    lon, lat = 106.9 + (F.col("x") - 600000) / 5000, 10.7 + (1200000 - F.col("y")) / 12000
    x, y = geo.lonlat_to_utm(lon, lat)
    p = points(spark, d).select("point_id", x.alias("x"), y.alias("y"))
    back_lon, back_lat = geo.utm_to_lonlat(F.col("x"), F.col("y"))
    out = p.withColumns({"lon": back_lon, "lat": back_lat})
    return rounded(rounded(out, "x", "y", digits=3), "lon", "lat", digits=7)
