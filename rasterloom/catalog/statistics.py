"""Statistics of bands, features and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import (
    YEARS, composite, composite_table, grid, landcover, landsat, obs, observations, pixels, query, rd, rounded, rq,
)
from rasterloom.functions import spectral as sp
from rasterloom.functions.columns import european_number
from rasterloom.operators import change, resample, scenes as sc, statistics as st, validity as va

F9 = cfg.FEATURES_9
_LONG9 = " UNION ALL ".join(f"""SELECT "year", '{f}' AS feature, {f} AS value FROM composite""" for f in F9)
_LONG6 = " UNION ALL ".join(f"""SELECT "year", '{b}' AS band, {b} AS v FROM pixels""" for b in cfg.BANDS)
_STATS = f"""count(value) AS count, {rq('avg(value)')} AS mean, {rq('stddev_samp(value)')} AS std, {rq('min(value)')} AS min,
  {rq('max(value)')} AS max, {rq('quantile_cont(value, 0.25)')} AS p25, {rq('quantile_cont(value, 0.5)')} AS median,
  {rq('quantile_cont(value, 0.75)')} AS p75"""
_STAT_COLS = ["mean", "std", "min", "max", "p25", "median", "p75"]


@query("band_statistics", f"""
SELECT "year", band, count(v) AS count, {rq('avg(v)', 4)} AS mean, {rq('stddev_pop(v)', 4)} AS std, min(v) AS min, max(v) AS max,
  count(*) AS total_count, count(*) - count(v) AS nodata_count, {rq('100.0::DOUBLE * (count(*) - count(v)) / count(*)')} AS nodata_pct,
  coalesce(min(v) < 0 OR max(v) > 10000, false) AS out_of_range FROM ({_LONG6}) GROUP BY 1, 2""", needs=("pixels",))
def band_statistics(spark, d):
    s = st.flag_out_of_range(st.band_statistics(pixels(spark, d)))
    return rounded(rounded(s, "mean", "std", digits=4), "nodata_pct")


@query("out_of_range_flags", f"""
SELECT band, coalesce(min(v) < 0 OR max(v) > 10000, false) AS out_of_range FROM ({_LONG6}) GROUP BY 1""", needs=("pixels",))
def out_of_range_flags(spark, d):
    return st.flag_out_of_range(st.band_statistics(pixels(spark, d), by=())).select("band", "out_of_range")


@query("quality_table", f"""
SELECT "year", count(*) AS total_pixels, count(B2) AS valid_pixels, count(*) - count(B2) AS nodata_pixels,
  {rq('100.0::DOUBLE * (count(*) - count(B2)) / count(*)')} AS nodata_pct,
  CAST(count_if(B2 > 10000 OR B3 > 10000 OR B4 > 10000 OR B8 > 10000 OR B11 > 10000 OR B12 > 10000) AS BIGINT) AS invalid_range_pixels
FROM pixels GROUP BY "year" """, needs=("pixels",))
def quality_table(spark, d):
    return rounded(st.quality_table(pixels(spark, d), va.any_out_of_range(cfg.BANDS)), "nodata_pct")


@query("feature_stats", f"SELECT feature, {_STATS} FROM ({_LONG9}) GROUP BY feature", needs=("composite",))
def feature_stats(spark, d):
    return rounded(st.feature_statistics(composite_table(spark, d), F9), *_STAT_COLS)


@query("feature_stats_by_year", f"""SELECT "year", feature, {_STATS} FROM ({_LONG9}) GROUP BY 1, 2""", needs=("composite",))
def feature_stats_by_year(spark, d):
    return rounded(st.feature_statistics(composite_table(spark, d), F9, ["year"]), *_STAT_COLS)


_PAIRS = [(a, b) for i, a in enumerate(F9) for b in F9[i + 1:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM composite" for a, b in _PAIRS)


@query("feature_corr", f"""
, p AS ({_CORR}) SELECT a, b, {rq('r')} AS r FROM (SELECT * FROM p UNION ALL SELECT b, a, r FROM p
  UNION ALL SELECT DISTINCT a, a, 1.0::DOUBLE FROM (SELECT a FROM p UNION ALL SELECT b FROM p))""", needs=("composite",))
def feature_corr(spark, d):
    return rounded(st.correlation_matrix(composite(spark, d), F9), "r")


@query("corr_top_pairs", f"SELECT a, b, {rq('r')} AS r FROM ({_CORR}) ORDER BY abs(r) DESC, a, b LIMIT 6", needs=("composite",))
def corr_top_pairs(spark, d):
    return rounded(st.strongest_pairs(composite(spark, d), F9), "r")


_HIST = """SELECT y."year", b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT "year" FROM composite) y
  CROSS JOIN (SELECT CAST(unnest(range(60)) AS INT) AS bin) b LEFT JOIN
  (SELECT "year", CAST(floor((NDBI - (-0.6::DOUBLE)) / ((0.6::DOUBLE - (-0.6::DOUBLE)) / 60)) AS INT) AS bin, count(*) AS n FROM composite
   WHERE NDBI IS NOT NULL GROUP BY 1, 2) h ON y."year" = h."year" AND b.bin = h.bin"""


@query("ndbi_histogram", f"""
SELECT "year", bin, {rq('-0.6::DOUBLE + bin * 0.02::DOUBLE')} AS lower, n FROM ({_HIST})""", needs=("composite",))
def ndbi_histogram(spark, d):
    return rounded(st.fixed_histogram(composite(spark, d), "NDBI"), "lower")


@query("histogram_percent", f"""
SELECT "year", bin, n, {rq('CASE WHEN sum(n) OVER (PARTITION BY "year") = 0 THEN n ELSE 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY "year") END')} AS pct
FROM ({_HIST})""", needs=("composite",))
def histogram_percent(spark, d):
    h = st.fixed_histogram(composite(spark, d), "NDBI").drop("lower")
    return rounded(st.percent_of_total(h), "pct")


_P = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("ndbi_summary", f"""
SELECT "year", count(NDBI) AS n, {rq('avg(NDBI)')} AS mean, {rq('stddev_pop(NDBI)')} AS std,
  {', '.join(f"{rq(f'quantile_cont(NDBI, {p})')} AS {n}" for n, p in _P.items())} FROM composite GROUP BY "year" """, needs=("composite",))
def ndbi_summary(spark, d):
    return rounded(st.value_summary(composite_table(spark, d), "NDBI"), "mean", "std", *_P)


@query("index_by_year", f"""
SELECT "year", {rq('quantile_cont(NDBI, 0.5)')} AS median, {rq('avg(NDBI)')} AS mean,
  {rq('100.0::DOUBLE * avg(CASE WHEN NDBI IS NULL THEN NULL WHEN NDBI > 0 THEN 1 ELSE 0 END)')} AS positive_pct
FROM composite GROUP BY "year" """, needs=("composite",))
def index_by_year(spark, d):
    """Median, mean and positive share compared over the years."""
    c = composite_table(spark, d)
    summary = st.value_summary(c, "NDBI", probs=(0.5,)).select("year", F.col("p50").alias("median"), "mean")
    return rounded(summary.join(st.positive_share(c), "year"), "median", "mean", "positive_pct")


@query("yearly_trend", f"""
SELECT "year", {rq('avg(NDVI)')} AS mean_NDVI, {rq('avg(NDBI)')} AS mean_NDBI, {rq('avg(NDWI)')} AS mean_NDWI
FROM composite GROUP BY "year" """, needs=("composite",))
def yearly_trend(spark, d):
    return rounded(st.yearly_trend(composite(spark, d)), "mean_NDVI", "mean_NDBI", "mean_NDWI")


@query("equal_width_hist", f"""
, l AS (SELECT feature, value FROM ({_LONG9}) WHERE value IS NOT NULL),
 s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1)
SELECT l.feature, CAST(least(59, coalesce(floor((value - lo) / nullif((hi - lo) / 60, 0)), 0)) AS INT) AS bin, count(*) AS n,
  {rq('min(value)')} AS min_value, {rq('max(value)')} AS max_value FROM l JOIN s ON l.feature = s.feature GROUP BY 1, 2""", needs=("composite",))
def equal_width_hist(spark, d):
    return rounded(st.equal_width_histogram(composite_table(spark, d), F9), "min_value", "max_value")


@query("boxplot_stats", f"""
, l AS (SELECT feature, value FROM ({_LONG9})),
 q AS (SELECT feature, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75 FROM l GROUP BY 1)
SELECT l.feature, {rq('any_value(p25)')} AS p25, {rq('any_value(median)')} AS median, {rq('any_value(p75)')} AS p75,
  {rq('min(value) FILTER (value BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25))')} AS whisker_low,
  {rq('max(value) FILTER (value BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25))')} AS whisker_high,
  CAST(count_if(value NOT BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)) AS BIGINT) AS n_outliers
FROM l JOIN q ON l.feature = q.feature GROUP BY 1""", needs=("composite",))
def boxplot_stats(spark, d):
    return rounded(st.boxplot_statistics(composite_table(spark, d), F9), "p25", "median", "p75", "whisker_low", "whisker_high")


@query("stretch", f"""
, q AS (SELECT quantile_cont(B4, 0.02) AS l4, quantile_cont(B4, 0.98) AS h4, quantile_cont(B3, 0.02) AS l3, quantile_cont(B3, 0.98) AS h3 FROM composite)
SELECT "year", "row", col, {rq('least(1, greatest(0, (B4 - l4) / nullif(h4 - l4, 0)))')} AS B4,
  {rq('least(1, greatest(0, (B3 - l3) / nullif(h3 - l3, 0)))')} AS B3 FROM composite, q""", needs=("composite",))
def stretch(spark, d):
    c = composite_table(spark, d).select("year", "row", "col", "B4", "B3")
    return rounded(st.percentile_stretch(c, ["B4", "B3"]), "B4", "B3")


@query("unpivot_features", f"""SELECT "year", "row", col, feature, {rq('value')} AS value FROM ({
    ' UNION ALL '.join(f"SELECT *, '{f}' AS feature, {f} AS value FROM composite" for f in cfg.INDICES)}) """, needs=("composite",))
def unpivot_features(spark, d):
    long = st.unpivot(composite(spark, d), ["year", "row", "col"], cfg.INDICES)
    return rounded(long, "value")


@query("feature_table", f"""
SELECT CAST("year" AS INT) AS "year", {', '.join(f'{rq("c." + f)} AS {f}' for f in F9)}, k.class,
  CASE k.class WHEN 0 THEN 'Water' WHEN 1 THEN 'Vegetation' WHEN 2 THEN 'Bare Soil' WHEN 3 THEN 'Built-up' END AS class_name
FROM composite c JOIN (SELECT "row", col, CAST(CASE wc WHEN 10 THEN 1 WHEN 20 THEN 1 WHEN 30 THEN 1 WHEN 40 THEN 1 WHEN 50 THEN 3 WHEN 60 THEN 2
  WHEN 80 THEN 0 WHEN 90 THEN 0 WHEN 95 THEN 0 ELSE -1 END AS INT) AS class FROM landcover) k ON c."row" = k."row" AND c.col = k.col""", needs=("composite", "landcover"))
def feature_table(spark, d):
    lab = landcover(spark, d).select("row", "col", change.remap_landcover(F.col("wc")).alias("class"))
    joined = composite(spark, d).join(lab, ["row", "col"])
    return rounded(change.with_class_name(joined.select("year", *F9, "class")), *F9)


@query("readiness", """
, c AS (SELECT count(*) AS n FROM pixels), f AS (SELECT count(NDVI) AS k FROM composite)
SELECT * FROM (
  SELECT 1 AS item, 'rows_present' AS "check", n > 0 AS ok FROM c
  UNION ALL SELECT 2, 'bands_present', n > 0 FROM c UNION ALL SELECT 3, 'invalid_masked', n > 0 FROM c
  UNION ALL SELECT 4, 'gaps_counted', n > 0 FROM c UNION ALL SELECT 5, 'indices_present', n > 0 AND k > 0 FROM c, f
  UNION ALL SELECT 6, 'features_described', n > 0 AND k > 0 FROM c, f UNION ALL SELECT 7, 'area_given', n > 0 FROM c
  UNION ALL SELECT 8, 'labels_given', false UNION ALL SELECT 9, 'can_classify', false)""",
       needs=("pixels", "composite"))
def readiness(spark, d):
    return st.readiness(pixels(spark, d), composite(spark, d), aoi_exists=True, training_exists=False)


@query("findings", f"""
, top AS (SELECT a, b, r FROM ({_CORR}) ORDER BY abs(r) DESC, a, b LIMIT 1), s AS (SELECT stddev_samp(NDVI) AS sd FROM composite),
 q AS (SELECT avg(p) AS m FROM (SELECT 100.0::DOUBLE * (count(*) - count(B2)) / count(*) AS p FROM pixels GROUP BY "year"))
SELECT a, b, {rq('r')} AS r, {rq('sd')} AS ndvi_std, {rq('m')} AS mean_nodata_pct, CASE WHEN sd > 0.2 THEN 'substantial' ELSE 'limited' END AS ndvi_spread
FROM top, s, q""", needs=("composite", "pixels"))
def findings(spark, d):
    quality = st.quality_table(pixels(spark, d), F.lit(False))
    return rounded(st.findings(composite(spark, d), quality, F9), "r", "ndvi_std", "mean_nodata_pct")


_S30 = """, s2 AS (SELECT "year", "row", col, (median(B11) - median(B8)) / nullif(median(B11) + median(B8), 0) AS ndbi
   FROM observations WHERE scl NOT IN (3, 8, 9, 10) GROUP BY 1, 2, 3),
 x AS (SELECT "year", CAST(floor("row" / 3) AS INT) AS "row", CAST(floor(col / 3) AS INT) AS col, avg(ndbi) AS x FROM s2 GROUP BY 1, 2, 3),
 y AS (SELECT "year", "row", col, (median(sr_b6 * 0.0000275::DOUBLE - 0.2::DOUBLE) - median(sr_b5 * 0.0000275::DOUBLE - 0.2::DOUBLE))
   / nullif(median(sr_b6 * 0.0000275::DOUBLE - 0.2::DOUBLE) + median(sr_b5 * 0.0000275::DOUBLE - 0.2::DOUBLE), 0) AS y
   FROM landsat WHERE (qa_pixel & 24) = 0 GROUP BY 1, 2, 3),
 xy AS (SELECT x."year", x."row", x.col, x.x, y.y FROM x JOIN y ON x."year" = y."year" AND x."row" = y."row" AND x.col = y.col)"""


def _two_sensors(spark, d):
    s2 = sc.sensor_ndbi(sc.mask_clouds(observations(spark, d)), "B11", "B8")
    coarse = resample.downsample_mean(s2, ["ndbi"], 3, keys=["year"]).withColumnRenamed("ndbi", "x")
    l8 = sp.landsat_reflectance(landsat(spark, d).where(sp.qa_clear(F.col("qa_pixel"))))
    return coarse.join(sc.sensor_ndbi(l8, "sr_b6", "sr_b5").withColumnRenamed("ndbi", "y"), ["year", "row", "col"])


@query("sensor_corr", _S30 + f"""
SELECT "year", count(*) AS n, {rq('corr(x, y)')} AS r, {rq('avg(x)')} AS mean_x, {rq('stddev_pop(x)')} AS std_x, {rq('avg(y)')} AS mean_y,
  {rq('stddev_pop(y)')} AS std_y, {rq('corr(x, y) * corr(x, y)')} AS r2,
  CASE WHEN corr(x, y) > 0.85 THEN 'high' WHEN corr(x, y) >= 0.7 THEN 'fair' ELSE 'review' END AS grade
FROM xy WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY "year" """, needs=("observations", "landsat"))
def sensor_corr(spark, d):
    return rounded(st.sensor_correlation(_two_sensors(spark, d)), "r", "mean_x", "std_x", "mean_y", "std_y", "r2")


@query("sensor_difference", _S30 + f"""SELECT "year", "row", col, {rq('x - y')} AS diff FROM xy""", needs=("observations", "landsat"))
def sensor_difference(spark, d):
    both = _two_sensors(spark, d)
    return both.select("year", "row", "col", rd(F.col("x") - F.col("y")).alias("diff"))


@query("formatted_numbers", f"""
SELECT "row", CAST(count(*) AS BIGINT) AS n, replace(replace(replace(format('{{:,.2f}}', sum(v) / 100.0::DOUBLE), ',', ' '), '.', ','), '', '') AS label
FROM grid GROUP BY "row" """, needs=("grid",))
def formatted_numbers(spark, d):
    sums = grid(spark, d).groupBy("row").agg(F.count(F.lit(1)).alias("n"), (F.sum("v") / 100.0).alias("s"))
    return sums.select("row", "n", european_number(F.col("s")).alias("label"))
