import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions import spectral as sp
from rasterloom.operators import points as pt, quantiles as qu, sampling as sa, scenes as sc, statistics as st, validity as va
from rasterloom.operators.polygons import clip_to_polygon

AFFINE = (10.0, 0.0, 600000.0, 0.0, -10.0, 1200000.0)
AOI = [[(600200.0, 1199000.0), (601000.0, 1199000.0), (601000.0, 1199800.0), (600200.0, 1199800.0)]]


@pytest.fixture(scope="module")
def scene(spark):
    """120 x 120 pixels, six bands, a 5 x 5 block of no data."""
    rng = np.random.default_rng(0)
    data = (rng.random((6, 120, 120)) * 9000 + 100).astype(int)
    rows = []
    for r in range(120):
        for c in range(120):
            gone = r < 5 and c < 5
            rows.append((2099, r, c, *[None if gone else int(data[b, r, c]) for b in range(6)]))
    names = ", ".join(f"{b} int" for b in cfg.BANDS)
    return spark.createDataFrame(rows, f"year int, row int, col int, {names}").cache()


def test_band_statistics(scene):
    stats = st.flag_out_of_range(st.band_statistics(scene)).collect()
    assert len(stats) == 6
    for s in stats:
        assert s.nodata_count == 25 and 0 <= s["min"] <= s["max"] and not s.out_of_range
        assert s.nodata_pct == pytest.approx(100 * 25 / 14400)


def test_validity_counts(scene):
    x = F.lit(600000.0) + (F.col("col") + 0.5) * 10
    y = F.lit(1200000.0) - (F.col("row") + 0.5) * 10
    from rasterloom.functions.geo import is_inside

    r = va.validity_counts(va.classify_validity(scene, inside=is_inside(x, y, AOI))).first()
    assert (r.total, r.valid, r.outside_aoi, r.missing, r.invalid_range, r.cloud) == (14400, 6400, 8000, 25, 0, 0)
    assert r.sampled == 6400


def test_clip_is_smaller(scene):
    clipped = clip_to_polygon(scene, AOI, AFFINE)
    r = clipped.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.count("*")).first()
    assert tuple(r) == (20, 99, 20, 99, 6400)


def test_points(scene, spark):
    pts = spark.createDataFrame([(i, i % 4, 600400.0 + 100 * i, 1199500.0 - 50 * i) for i in range(4)], "point_id int, label int, x double, y double")
    pts = pt.validate_training_points(pts)
    outside = spark.createDataFrame([(9, 1, 0.0, 0.0)], "point_id int, class int, x double, y double")
    got = {r.point_id: r for r in pt.extract_at_points(scene, pts.select("point_id", "class", "x", "y").union(outside), AFFINE, cfg.BANDS).collect()}
    assert [(got[i].row, got[i].col) for i in range(4)] == [(50 + 5 * i, 40 + 10 * i) for i in range(4)]
    assert got[0].B2 > 0 and got[9].B2 is None and len(got) == 5
    with pytest.raises(ValueError):
        pt.validate_training_points(pts.drop("x"))


def test_chips_are_whole_and_local(scene, spark):
    pts = spark.createDataFrame([(1, 60, 60), (2, 2, 2), (3, 63, 64)], "point_id int, row int, col int")
    n = {r.point_id: r["count"] for r in pt.chips(scene, pts, half=4, tile=16).groupBy("point_id").count().collect()}
    assert n == {1: 81, 2: 49, 3: 81}


def test_indices_at_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (3, 1, 2, 5)], "B3 int, B4 int, B8 int, B11 int")
    rows = sp.add_indices(df).orderBy("B3").collect()
    assert rows[0].NDVI is None and rows[1].NDVI == pytest.approx(1 / 3)
    assert all(-1 <= rows[1][i] <= 1 for i in cfg.INDICES)
    clamp = sp.add_indices(df, "clamp").orderBy("B3").first()
    assert clamp.NDVI == 0.0
    with pytest.raises(ValueError):
        sp.add_indices(df.drop("B11"))


def test_median_composite_with_a_hot_pixel(spark):
    """One pixel holds most observations; no job runs while planning."""
    hot = spark.range(3000).selectExpr("int(2000) year", "int(0) row", "int(0) col", "int(id % 100) B8", "int(3) scl")
    rest = spark.range(1000).selectExpr("int(2000) year", "int(id) + 1 row", "int(1) col", "int(id) B8", "int(4) scl")
    got = sc.median_composite(hot.union(rest), bands=["B8"], scale=False)
    assert got.where("row = 0").first().B8 == 49.5 and got.count() == 1001
    assert got.where("row = 8").first().B8 == 7 and got.where("row = 0").first().n_obs == 3000


def test_quantiles_match_numpy(spark, rng):
    v = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.normal(scale=1e6, size=5)])
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "g int, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.q for r in qu.exact_quantiles(df, ["g"], "v", probs, buckets=64).collect()}
    for g in (0, 1):
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(v[g::2], p), rel=1e-12)
    one = {r.p: r.q for r in qu.exact_quantiles(df, [], "v", probs, bounds=(-1, 1)).collect()}
    assert one[0.5] == pytest.approx(np.quantile(v, 0.5))


def _md5(seed, r, c):
    return hashlib.md5(f"{seed}:{r}:{c}".encode()).hexdigest()


def test_sample_is_exact_and_repeatable(scene):
    valid = scene.dropna()
    a = {(r.row, r.col) for r in sa.sample_pixels(valid, 500).collect()}
    keys = [(r.row, r.col) for r in valid.select("row", "col").collect()]
    assert a == set(sorted(keys, key=lambda k: _md5(42 + 2099, *k))[:500])
    assert a == {(r.row, r.col) for r in sa.sample_pixels(valid.repartition(7), 500).collect()}
    assert sa.sample_pixels(valid, 10**6).count() == len(keys)


def test_exact_split(spark):
    df = spark.range(1005).selectExpr("int(id) row", "int(0) col", "int(if(id < 1000, 1, 2)) class")
    n = {(r["class"], r.is_train): r["count"] for r in sa.exact_split(df).groupBy("class", "is_train").count().collect()}
    assert n == {(1, True): 700, (1, False): 300, (2, True): 4, (2, False): 1}
    with pytest.raises(ValueError):
        sa.check_class_sizes(df)


def test_representative_years(spark):
    many = spark.createDataFrame([(y,) for y in (2018, 2020, 2022, 2024)], "year int")
    assert sorted(r.year for r in sc.representative_years(many).collect()) == [2018, 2022, 2024]
    assert sc.representative_years(many.where("year < 2023")).count() == 3


def test_same_grid(spark):
    meta = spark.createDataFrame([(1, 10, 10, 0.0, 0.0, 10.0, 10.0), (2, 10, 11, 0.0, 0.0, 10.0, 10.0)],
                                 "year int, width int, height int, xmin double, ymax double, resolution_x double, resolution_y double")
    sc.same_grid(meta.where("year = 1"))
    with pytest.raises(ValueError):
        sc.same_grid(meta)
