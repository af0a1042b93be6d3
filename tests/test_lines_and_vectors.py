import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import hough as ho, polygons as po, vectors as ve
from rasterloom.operators.polygons import EDGE, edge_table, polygon_area, with_inside

# Published boundary of the airport (lon, lat), outer ring and hole.
OUTER = [
    (107.0206747, 10.7387088), (107.0058396, 10.7579755), (107.0037796, 10.760647), (107.0000221, 10.7655302),
    (107.0098628, 10.7724916), (107.0117154, 10.7738199), (107.0316868, 10.7881602), (107.0488599, 10.8004907),
    (107.057488100000015, 10.8066856), (107.073944, 10.8184914), (107.0811055, 10.8089679), (107.0857225, 10.8029021),
    (107.0864315, 10.8019643), (107.1012667, 10.7823348), (107.0858356, 10.7714146), (107.0646493, 10.7565221),
    (107.0431452, 10.7413464), (107.0289623, 10.7312581), (107.027334900000014, 10.730085), (107.0206747, 10.7387088),
]
HOLE = [
    (107.067647, 10.7903199), (107.0508993, 10.7781681), (107.046613100000016, 10.783891), (107.0491612, 10.7857564),
    (107.0489037, 10.7861042), (107.0587742, 10.7933025), (107.0624757, 10.7951942), (107.0634198, 10.7958582),
    (107.067647, 10.7903199),
]


@pytest.fixture(scope="module")
def airport(spark):
    rows = [(n, i, *p) for n, ring in (("outer", OUTER), ("hole", HOLE)) for i, p in enumerate(ring)]
    df = spark.createDataFrame(rows, "ring string, i int, lon double, lat double")
    x, y = geo.lonlat_to_utm(F.col("lon"), F.col("lat"))
    pts = df.select("ring", "i", F.struct(x.alias("x"), y.alias("y")).alias("p"))
    seq = F.array_sort(F.collect_list(F.struct("i", "p")))
    return pts.groupBy("ring").agg(F.transform(seq, lambda s: s["p"]).alias("coords")).cache()


def test_projection_of_the_centre(spark):
    df = spark.createDataFrame([(107.04111, 10.78444)], "lon double, lat double")
    x, y = geo.lonlat_to_utm(F.col("lon"), F.col("lat"))
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(723183.343, abs=2e-3) and r.y == pytest.approx(1192889.111, abs=2e-3)


def test_airport_area_and_axis(airport):
    area = {r.ring: r.ha for r in airport.select("ring", (ve.ring_area(F.col("coords")) / 1e4).alias("ha")).collect()}
    assert area["outer"] == pytest.approx(4935.3, abs=0.1) and area["outer"] - area["hole"] == pytest.approx(4749.2, abs=0.1)
    axis = ve.principal_axis(airport.where("ring = 'outer'")).first()
    assert round(axis.length, 1) == 10059.6 and round(axis.bearing_deg, 2) == 53.69


def test_line_bearings(spark):
    rows = [(2022, 765, 413, 626, 253), (2024, 840, 390, 683, 547), (2024, 621, 513, 553, 710), (2024, 710, 734, 674, 531)]
    df = spark.createDataFrame(rows, "year int, row1 int, col1 int, row2 int, col2 int")
    got = ho.with_bearing_and_length(df, 10.0032)
    assert sorted(round(r.bearing_deg, 2) for r in got.collect()) == [45.0, 70.96, 100.06, 130.98]
    assert sorted(round(r.length_m, 1) for r in got.collect()) == pytest.approx([2062.3, 2084.7, 2120.1, 2221.0], abs=0.2)


def test_clip_with_hole(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    segs = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0), (2, 20.0, 0.0, 20.0, 9.0), (3, 1.0, 1.0, 3.0, 1.0)],
                                 "fid int, x1 double, y1 double, x2 double, y2 double")
    def total(keep):
        out = ve.clip_segments(segs, square, keep).groupBy("fid").agg(F.sum("length_m").alias("m")).collect()
        return {r.fid: round(r.m, 9) for r in out}
    assert total("inside") == {1: 8.0, 3: 2.0} and total("outside") == {1: 12.0, 2: 9.0}
    assert ve.length_inside(segs, square).first().inside_m == pytest.approx(10.0)
    kept, removed = ve.clip_features(segs, [[(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)]], square, min_length=10.0)
    assert {r.fid for r in kept.collect()} == {1}
    assert ve.length_inside(kept, square).first().inside_m <= 0.1


def test_polygon_paths_agree(spark, airport):
    affine = (100.0, 0.0, 716000.0, 0.0, -100.0, 1198000.0)
    rings = [[(p.x, p.y) for p in r.coords] for r in airport.collect()]
    cells = spark.range(160 * 160).selectExpr("int(id / 160) row", "int(id % 160) col")
    x, y = geo.pixel_center(F.col("row"), F.col("col"), affine)
    a = {tuple(r) for r in cells.where(geo.is_inside(x, y, rings)).collect()}
    edges = spark.createDataFrame(geo.polygon_edges(rings), "x1 double, y1 double, x2 double, y2 double")
    b = {tuple(r) for r in po.rasterize_polygon(edges, affine).collect()}
    assert a == b
    assert len(a) == pytest.approx(4749, abs=40)


def test_grouping_and_hit_rate(spark):
    rows = [(1, 0, 0, 0, 30), (2, 5, 0, 7, 25), (3, 0, 0, 20, 0), (4, 9, 0, 9, 10)]
    segs = ho.with_bearing_and_length(spark.createDataFrame(rows, "seg int, row1 int, col1 int, row2 int, col2 int").withColumn("year", F.lit(1)))
    g = {r.seg: r for r in ho.group_segments(segs).collect()}
    assert g[1].group == g[2].group == g[4].group == 1 and g[3].group == 2
    w = [(g[i].bearing_deg, g[i].length_m) for i in (1, 2, 4)]
    assert g[1].group_bearing_deg == pytest.approx(sum(b * l for b, l in w) / sum(l for _, l in w))
    cls = spark.createDataFrame([(1, 1, c, 3) for c in range(15)], "year int, row int, col int, class int")
    rate = {r.seg: r.builtup_pct for r in ho.hit_rate(segs, cls).collect()}
    assert rate[3] == pytest.approx(100 * 3 / 20) and rate[4] == 0.0
    assert rate[1] == pytest.approx(100 * sum(int(x) <= 15 for x in np.linspace(0, 30, 30)) / 30, abs=0.05)


def greedy(rows, tolerance):
    """Segment by segment, longest first."""
    groups, where = [], {}
    for seg, b, length in sorted(rows, key=lambda r: (-r[2], r[1])):
        for g in groups:
            d = abs(b - g["b"])
            if min(d, 180 - d) <= tolerance:
                break
        else:
            g = {"b": b, "of": []}
            groups.append(g)
        g["of"].append((b, length))
        g["b"] = sum(x * w for x, w in g["of"]) / sum(w for _, w in g["of"])
        where[seg] = g
    ranked = sorted(groups, key=lambda g: -sum(w for _, w in g["of"]))
    return {seg: (ranked.index(g) + 1, g["b"], sum(w for _, w in g["of"])) for seg, g in where.items()}


def test_grouping_equals_the_greedy_rule(spark):
    """One segment in each cell of bearing and length, two layers."""
    rng = np.random.default_rng(4)
    bins = rng.permutation(3600)[:600]
    rows = [(i, i % 2, (b + 0.1 + 0.8 * rng.random()) * ho.BEARING_BIN, float(rng.integers(10, 900))) for i, b in enumerate(bins.tolist())]
    df = spark.createDataFrame(rows, "seg int, year int, bearing_deg double, length_m double")
    got = {r.seg: (r.group, r.group_bearing_deg, r.group_total_len_m) for r in ho.group_segments(df).collect()}
    want = greedy([(i, b, w) for i, y, b, w in rows if y == 0], 7.0) | greedy([(i, b, w) for i, y, b, w in rows if y == 1], 7.0)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i])


def test_grouping_sees_cells_not_segments(spark):
    """Many segments of few cells: sums are exact, and the step's input does not grow with them."""
    df = spark.range(40_000).selectExpr("2022 AS year", "id % 3 * 40 + 1 + (id % 7) / 1000.0D AS bearing_deg", "100.0D + id % 5 AS length_m")
    rows = ho.group_segments(df).groupBy("group").agg(F.count("*").alias("n"), F.sum("length_m").alias("w"), F.max("group_total_len_m").alias("total")).collect()
    assert len(rows) == 3 and sum(r.n for r in rows) == 40_000
    assert all(r.w == pytest.approx(r.total) for r in rows)
    assert df.select(*ho._cell(F.col("bearing_deg"), F.col("length_m"))).distinct().count() <= 6
    assert ho.group_segments(df.limit(0)).count() == 0


def test_summary_counts_edge_pixels_and_peaks(spark):
    segs = spark.createDataFrame([(1, 1, 45.0, 100.0, 50.0, 45.0, 100.0)], "year int, group int, bearing_deg double, length_m double, builtup_pct double, group_bearing_deg double, group_total_len_m double")
    edges = spark.createDataFrame([(1, r, 3) for r in range(4)], "year int, row int, col int")
    peaks = spark.createDataFrame([(1, 2, 30.0), (1, 1, 90.004)], "year int, peak int, bearing_deg double")
    out = {r.year: r for r in ho.line_summary(segs, layers=spark.createDataFrame([(1,), (2,)], "year int"), edges=edges, peaks=peaks).collect()}
    assert (out[1].edge_px, out[1].peak_bearings_deg) == (4, [90.0, 30.0])
    assert (out[2].edge_px, out[2].peak_bearings_deg, out[2].n_segments) == (0, [], 0)


def test_circular_grouping(spark):
    rows = [(1, 179.0, 30.0), (2, 1.0, 20.0)]
    df = spark.createDataFrame(rows, "seg int, bearing_deg double, length_m double").withColumn("year", F.lit(1))
    linear = ho.group_segments(df).first().group_bearing_deg
    circular = ho.group_segments(df, mode="circular").first().group_bearing_deg
    assert linear == pytest.approx((179 * 30 + 20) / 50) and min(circular, 180 - circular) < 1


def test_lines_found_on_a_cross(spark):
    pts = [(r, 40) for r in range(80)] + [(20, c) for c in range(80) if not 50 <= c < 75]
    df = spark.createDataFrame(sorted(set(pts)), "row int, col int")
    acc = ho.votes(df)
    best = ho.peaks(acc, n=2).orderBy("peak").collect()
    assert {(p.t, abs(p.rho)) for p in best} == {(90, 40), (0, 20)}
    segs = ho.segments(df, ho.peaks(acc, n=2), min_length=40, gap=20).orderBy("length_m").collect()
    assert [s.length_m for s in segs] == [490.0, 790.0]


def test_hull_of_random_points(rng):
    pts = rng.random((200, 2))
    hull = ve._hull(np.unique(pts, axis=0))
    edge = np.roll(hull, -1, axis=0) - hull
    for p in pts:
        d = p - hull
        assert (edge[:, 0] * d[:, 1] - edge[:, 1] * d[:, 0] >= -1e-12).all()


def test_sectors_and_rings(spark):
    pts = [(0.0, 1.0, 0), (1.0, 1.0, 1), (1.0, 0.0, 2), (0.0, -1.0, 4), (-1.0, 0.0, 6), (-1.0, 1.0, 7)]
    df = spark.createDataFrame(pts, "dx double, dy double, s int")
    assert all(r.s == r.got for r in df.withColumn("got", geo.compass_sector(F.col("dx"), F.col("dy"))).collect())
    lab = spark.createDataFrame([(0.0,), (2000.0,), (5999.9,), (6000.0,)], "d double").select(geo.band_label(F.col("d"), [0, 2000, 4000, 6000]).alias("l"))
    assert [r.l for r in lab.collect()] == ["0-2000", "2000-4000", "4000-6000", None]


def test_every_line_is_found(spark):
    """Six lines of one length, and a weak one beside them."""
    from rasterloom.operators import hough as ho

    px = {(r, c) for r in (5, 25, 45, 65, 85, 105) for c in range(10, 90)} | {(r, 130) for r in range(40, 65)}
    edges = spark.createDataFrame(sorted(px), "row int, col int")
    found = ho.all_segments(edges, min_length=20, gap=3).collect()
    rows = {r.row1 for r in found if r.row1 == r.row2 and abs(r.col2 - r.col1) == 79}
    assert rows == {5, 25, 45, 65, 85, 105}
    assert [abs(r.row2 - r.row1) for r in found if r.col1 == r.col2 == 130] == [24]
    assert len(found) == 7


def test_a_year_without_segments_has_a_row(spark):
    from rasterloom.operators import hough as ho

    segs = spark.createDataFrame([(2022, 1, 45.0, 100.0, 50.0, 45.0, 100.0)], "year int, group int, bearing_deg double, length_m double, builtup_pct double, group_bearing_deg double, group_total_len_m double")
    out = {r.year: r for r in ho.line_summary(segs, layers=spark.createDataFrame([(2022,), (2024,)], "year int")).collect()}
    assert out[2022].n_segments == 1 and out[2024].n_segments == 0 and out[2024].longest_single_segment_m == 0 and out[2024].dominant_bearing_deg is None


def test_line_queries_follow_every_line(spark, tmp_path):
    """Seven lines, one of them weak; and a map without any built-up pixel."""
    from rasterloom.catalog import lines
    from rasterloom.catalog.base import WIDTH

    px = {(r, c) for r in (5, 25, 45, 65, 85, 105) for c in range(10, 90)} | {(r, 99) for r in range(40, 65)}
    cells = [(r * WIDTH + c, 3.0 if (r, c) in px else 0.0) for r in range(110) for c in range(100)]
    for name, rows in (("lines", cells), ("none", [(i, 0.0) for i, _ in cells])):
        spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/{name}/events.parquet")
    found = lines.line_summary(spark, f"{tmp_path}/lines").first()
    assert found.n_segments >= 7 and found.n_groups == 2 and found.dominant_n_segments >= 6
    empty = lines.line_summary(spark, f"{tmp_path}/none").collect()
    assert [(r.year, r.n_segments) for r in empty] == [(2022, 0)]


def star(n, seed, holes=False):
    """A ring with n edges about (0, 0), jagged."""
    rng = np.random.default_rng(seed)
    a = np.sort(rng.random(n)) * 2 * np.pi
    r = 500 + 400 * rng.random(n)
    ring = list(zip((r * np.cos(a)).tolist(), (r * np.sin(a)).tolist()))
    return [ring, [(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)]] if holes else [ring]


def even_odd(x, y, rings):
    inside = np.zeros(len(x), bool)
    for x1, y1, x2, y2 in geo.polygon_edges(rings):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return inside


@pytest.mark.parametrize("n,size", [(4, None), (60, 37.0), (5000, None), (5000, 300.0)])
def test_points_in_polygons_of_any_size(spark, n, size):
    rings = star(n, n, holes=True)
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-1000, 1000, (2, 1500))
    x[:40], y[:40] = np.repeat(np.arange(-200.0, 200.0, 50), 5), 100.0  # on a border, on tile lines
    x[40:80], y[40:80] = 100.0, np.linspace(-150, 150, 40)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    edges = spark.createDataFrame(geo.polygon_edges(rings), EDGE)
    found = dict(with_inside(points, edges, ["id"], size).select("id", "inside").collect())
    want = even_odd(x, y, rings)
    assert [found[i] for i in range(len(x))] == want.tolist()


def test_clipping_with_5000_edges(spark):
    rings = star(5000, 9, holes=True)
    rng = np.random.default_rng(2)
    lines = [(i, *map(float, rng.uniform(-900, 900, 4))) for i in range(12)] + [(12, -950.0, 0.0, 950.0, 0.0), (13, 0.0, 0.0, 0.0, 0.0), (14, 5000.0, 5000.0, 5001.0, 5000.0)]
    segs = spark.createDataFrame(lines, "fid long, x1 double, y1 double, x2 double, y2 double")
    both = {side: {r["fid"]: r["m"] for r in ve.clip_segments(segs, rings, side).groupBy("fid").agg(F.sum("length_m").alias("m")).collect()} for side in ("inside", "outside")}
    for fid, x1, y1, x2, y2 in lines:
        whole = np.hypot(x2 - x1, y2 - y1)
        t = (np.arange(200_000) + 0.5) / 200_000
        share = even_odd(x1 + (x2 - x1) * t, y1 + (y2 - y1) * t, rings).mean()
        assert abs(both["inside"].get(fid, 0.0) - share * whole) < 0.2
        assert abs(both["inside"].get(fid, 0.0) + both["outside"].get(fid, 0.0) - whole) < 1e-6


def test_both_ways_of_clipping_agree(spark):
    rings = star(50, 4, holes=True)
    rng = np.random.default_rng(3)
    segs = spark.createDataFrame([(i, *map(float, rng.uniform(-900, 900, 4))) for i in range(60)], "fid long, x1 double, y1 double, x2 double, y2 double")
    edges = spark.createDataFrame(geo.polygon_edges(rings), EDGE)
    for side in ("inside", "outside"):
        a, b = (sorted((r["fid"], round(r["x1"], 6), round(r["y2"], 6), round(r["length_m"], 6)) for r in ve.clip_segments(segs, x, side).collect()) for x in (rings, edges))
        assert a == b and a


def test_edge_table_and_areas(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    rows = spark.createDataFrame([(1, [[dict(x=x, y=y) for x, y in r] for r in (square, hole)]), (2, [])], "fid long, rings array<array<struct<x:double,y:double>>>")
    assert {r["fid"]: r["a"] for r in rows.select("fid", polygon_area(F.col("rings")).alias("a")).collect()} == {1: 96.0, 2: 0.0}
    edges = edge_table(rows, ["fid"]).collect()
    assert sorted((r["x1"], r["y1"], r["x2"], r["y2"]) for r in edges) == sorted(geo.polygon_edges([square, hole]))


def all_runs(pixels, min_length, gap, width=1.0):
    """Every run along every line, then those that most of their pixels count for."""
    runs = []
    for t in range(180):
        a = np.radians(t - 90.0)
        d = {p: p[1] * np.cos(a) + p[0] * np.sin(a) for p in pixels}
        along = {p: round(p[0] * np.cos(a) - p[1] * np.sin(a), 6) for p in pixels}
        for rho in range(-100, 101):
            on = sorted((along[p], p) for p in pixels if -1e-9 <= d[p] - rho + width and d[p] - rho - width <= 1e-9)
            run, number = [], 0
            for k, x in enumerate(on):
                if run and x[0] - run[-1][0] > gap:
                    runs.append((t, rho, number, run))
                    run, number = [], number + 1
                run = [*run, x]
            if run:
                runs.append((t, rho, number, run))
    runs = [(round(r[-1][0] - r[0][0], 6), len(r), -t, -rho, -u, r) for t, rho, u, r in runs if round(r[-1][0] - r[0][0], 6) >= min_length]
    best = {}
    for r in runs:
        for _, p in r[5]:
            best[p] = max(best.get(p, r[:5]), r[:5])
    return sorted((-r[2], -r[3], *r[5][0][1], *r[5][-1][1]) for r in runs if 2 * sum(best[p] == r[:5] for _, p in r[5]) >= r[1])


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_no_run_is_lost(spark, seed):
    if seed is None:  # twelve pixels three columns apart, their rows 9, 10, 11 in turn
        pixels, least = [(9 + i % 3, 3 * i) for i in range(12)], 24
    else:
        rng = np.random.default_rng(seed)
        pixels, least = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2))}), 8
    df = spark.createDataFrame(pixels, "row int, col int")
    found = ho.all_segments(df, min_length=least, gap=3)
    got = sorted(tuple(r[c] for c in ("t", "rho", "row1", "col1", "row2", "col2")) for r in found.collect())
    assert got == all_runs(pixels, least, 3) and got
