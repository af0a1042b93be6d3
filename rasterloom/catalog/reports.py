"""Report rows: quality text, sample summaries, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import config as cfg, sinks
from rasterloom.catalog.base import AFFINE, composite_table, pixels, query, rd, rounded, rq, segments
from rasterloom.catalog.statistics import _LONG9
from rasterloom.functions.columns import hash_key
from rasterloom.operators import sampling as sa, scenes as sc, statistics as st, validity as va

@query("qc_report", f"""
SELECT "year", format('year {{}}, grid {{}} x {{}}', "year", w, h) || chr(10)
 || format('pixels {{}} = {{}} with data + {{}} without ({{:.3f}} %)', CAST(w * h AS BIGINT), valid, CAST(w * h - valid AS BIGINT), 100.0::DOUBLE * (w * h - valid) / (w * h)) || chr(10)
 || 'layers {' '.join(cfg.BANDS)} {' '.join(cfg.INDICES)}' || chr(10) || 'EPSG:32648, cells of 10.00 by 10.00' AS report
FROM (SELECT "year", CAST(max("row") + 1 AS BIGINT) AS h, CAST(max(col) + 1 AS BIGINT) AS w, count(B2) AS valid FROM pixels GROUP BY "year")""", needs=("pixels",))
def qc_report(spark, d):
    p = pixels(spark, d)
    return sinks.qc_report(sc.raster_metadata(p, AFFINE, cfg.BANDS, "EPSG:32648"), st.band_statistics(p))


@query("sample_summary", f"""
, s AS (SELECT "year", "row", col FROM (SELECT *, row_number() OVER (PARTITION BY "year" ORDER BY md5((42 + "year") || ':' || "row" || ':' || col)) AS rn FROM composite) WHERE rn <= {cfg.SAMPLES_PER_YEAR}),
 l AS ({_LONG9.replace('FROM composite', 'FROM composite SEMI JOIN s USING ("year", "row", col)')})
SELECT "year", feature, {rq('avg(value)')} AS mean, {rq('stddev_samp(value)')} AS std, {rq('min(value)')} AS min, {rq('median(value)')} AS median, {rq('max(value)')} AS max FROM l GROUP BY 1, 2""", needs=("composite",))
def sample_summary(spark, d):
    """Feature summary of every year's pixel sample."""
    sample = sa.sample_pixels(composite_table(spark, d))
    table = st.feature_statistics(sample, cfg.FEATURES_9, ["year"])
    return rounded(table.select("year", "feature", "mean", "std", "min", "median", "max"), "mean", "std", "min", "median", "max")


@query("validity_percent", f"""
, k AS (SELECT "year", count(*) AS n, count_if(B2 IS NULL) AS m, count_if(B2 > 10000 OR B3 > 10000 OR B4 > 10000 OR B8 > 10000 OR B11 > 10000 OR B12 > 10000) AS i FROM pixels GROUP BY 1)
SELECT "year", {rq('100.0::DOUBLE * m / n')} AS missing_pct, {rq('100.0::DOUBLE * i / n')} AS invalid_range_pct, {rq('100.0::DOUBLE * (n - m - i) / n')} AS valid_pct FROM k""", needs=("pixels",))
def validity_percent(spark, d):
    counts = va.validity_counts(va.classify_validity(pixels(spark, d)), cap=None)
    return counts.select("year", *[rd(100.0 * F.col(f) / F.col("total")).alias(f"{f}_pct") for f in ("missing", "invalid_range", "valid")])


@query("feature_json", """
SELECT '{"type":"Feature","properties":{"fid":' || fid || ',"highway":"' || highway || '"},"geometry":{"type":"LineString","coordinates":[['
 || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || '],[' || CAST(x2 AS BIGINT) || ',' || CAST(y2 AS BIGINT) || ']]}}' AS value FROM segments""", needs=("segments",))
def feature_json(spark, d):
    def point(x, y):
        return F.array(F.col(x).cast("bigint"), F.col(y).cast("bigint"))
    lines = segments(spark, d).withColumn("c", F.array(point("x1", "y1"), point("x2", "y2")))
    return sinks.feature_json(lines, "LineString", "c", ["fid", "highway"])


@query("hash_order", """SELECT fid, md5('42:' || fid) AS h FROM segments""", needs=("segments",))
def hash_order(spark, d):
    """The reproducible order all samples use."""
    return segments(spark, d).select("fid", hash_key(cfg.SEED, F.col("fid")).alias("h"))
