"""Samples, splits, points and chips."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import AFFINE, YEARS, composite, composite_table, grid, labelled, pixels, points, query, rd, rounded, rq
from rasterloom.operators import change as ch, points as pt, sampling as sa, validity as va

_KEY = """"row" || ':' || col"""


@query("reservoir_sample", f"""
SELECT "year", "row", col, {rq('NDVI')} AS NDVI FROM (SELECT *, row_number() OVER (PARTITION BY "year" ORDER BY md5((42 + "year") || ':' || {_KEY})) AS rn FROM composite)
WHERE rn <= {cfg.SAMPLES_PER_YEAR}""", needs=("composite",))
def reservoir_sample(spark, d):
    return rounded(sa.sample_pixels(composite_table(spark, d).select("year", "row", "col", "NDVI")), "NDVI")


_BY = '"year", class'
_N = cfg.SAMPLES_PER_CLASS


def _labels(spark, d):
    return labelled(spark, d).select("year", "row", "col", "NDVI", "NDBI", "NDWI", "class")


@query("stratified_sample", f"""SELECT "year", "row", col, class FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('42:' || {_KEY})) AS rn FROM labelled) WHERE rn <= {_N}""", needs=("labelled",))
def stratified_sample(spark, d):
    return sa.stratified_sample(_labels(spark, d), by=["year"]).select("year", "row", "col", "class")


_GROUND = f""", l AS (SELECT c."year", c."row", c.col, c.NDVI, c.NDBI, c.NDWI, (g.v % 4)::INT AS class FROM composite c JOIN grid g ON c."row" = g."row" AND c.col = g.col
   WHERE NDVI IS NOT NULL AND NDBI IS NOT NULL AND NDWI IS NOT NULL),
 cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('42:' || "row" || ':' || col)) AS rn FROM l WHERE class = 0) WHERE rn <= {cfg.WATER_OVERSAMPLE}),
 water AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "year" ORDER BY md5('42:sort:' || "row" || ':' || col)) AS r2 FROM cand WHERE NDWI > 0) WHERE r2 <= {_N}),
 others AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('42:' || "row" || ':' || col)) AS rn FROM l WHERE class IN (1, 2, 3)) WHERE rn <= {_N})"""


def _ground(spark, d):
    """Composite with independent labels, so water labels can be wrong."""
    lab = grid(spark, d).select("row", "col", (F.col("v") % 4).cast("int").alias("class"))
    return composite(spark, d).select("year", "row", "col", *cfg.INDICES).join(lab, ["row", "col"])


@query("cleaned_water_sample", _GROUND + """SELECT "year", "row", col, class FROM water UNION ALL SELECT "year", "row", col, class FROM others""", needs=("composite", "grid"))
def cleaned_water_sample(spark, d):
    return sa.cleaned_sample(_ground(spark, d), by=["year"])[0].select("year", "row", "col", "class")


@query("cleaning_stats", _GROUND + f"""SELECT "year", count(*) AS water_candidates, CAST(count_if(NDWI > 0) AS BIGINT) AS water_passed_ndwi_filter,
 CAST(least(count_if(NDWI > 0), {_N}) AS BIGINT) AS water_final_used, {rq('100.0::DOUBLE * (1.0 - count_if(NDWI > 0) / count(*)::DOUBLE)')} AS water_removed_pct, 0.0::DOUBLE AS ndwi_threshold FROM cand GROUP BY 1""", needs=("composite", "grid"))
def cleaning_stats(spark, d):
    return rounded(sa.cleaned_sample(_ground(spark, d), by=["year"])[1], "water_removed_pct")


@query("region_sample", f"""SELECT "row", col, v FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || {_KEY})) AS rn FROM grid
 WHERE "row" BETWEEN 10 AND 90 AND col BETWEEN 20 AND 70) WHERE rn <= 80""", needs=("grid",))
def region_sample(spark, d):
    inside = F.col("row").between(10, 90) & F.col("col").between(20, 70)
    return sa.sample_region(grid(spark, d), inside, 80).select("row", "col", "v")


_U = f"""('0x' || substr(md5('42:' || {_KEY}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"""


@query("train_test_split", f"""SELECT "year", ({_U} < 0.7) AS is_train, class, count(*) AS n FROM labelled GROUP BY 1, 2, 3""", needs=("labelled",))
def train_test_split(spark, d):
    train, test = sa.train_test_split(_labels(spark, d))
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    return both.groupBy("year", "is_train", "class").agg(F.count(F.lit(1)).alias("n"))


@query("exact_split", f"""SELECT "year", "row", col, class, rn <= round_even(0.7::DOUBLE * n, 0) AS is_train FROM (
 SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('42:' || {_KEY})) AS rn, count(*) OVER (PARTITION BY {_BY}) AS n FROM labelled)""", needs=("labelled",))
def exact_split(spark, d):
    return sa.exact_split(_labels(spark, d), by=["year"]).select("year", "row", "col", "class", "is_train")


@query("qc_points", f"""SELECT "year", "row", col, class FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('7:' || {_KEY})) AS rn FROM
 (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('42:' || {_KEY})) AS r1 FROM labelled) WHERE r1 <= {_N}) WHERE rn <= 20""", needs=("labelled",))
def qc_points(spark, d):
    return sa.qc_points(sa.stratified_sample(_labels(spark, d), by=["year"]), 20, seed=7, by=["year"]).select("year", "row", "col", "class")


_PLACED = """, pp AS (SELECT *, CAST(floor((y - 1200000.0::DOUBLE) / -10.0::DOUBLE) AS INT) AS "row", CAST(floor((x - 600000.0::DOUBLE) / 10.0::DOUBLE) AS INT) AS col FROM points)"""


@query("point_extract", _PLACED + """SELECT p.point_id, p."row", p.col, p.class, g.v FROM pp p LEFT JOIN grid g ON p."row" = g."row" AND p.col = g.col""", needs=("points", "grid"))
def point_extract(spark, d):
    out = pt.extract_at_points(grid(spark, d), pt.validate_training_points(points(spark, d)), AFFINE, ["v"])
    return out.select("point_id", "row", "col", "class", "v")


@query("point_class_counts", _PLACED + f"""SELECT CASE p.class WHEN 0 THEN 'Water' WHEN 1 THEN 'Vegetation' WHEN 2 THEN 'Bare Soil' ELSE 'Built-up' END AS class_name,
 count(*) AS n FROM pp p GROUP BY 1""", needs=("points",))
def point_class_counts(spark, d):
    from rasterloom.operators.statistics import class_counts

    return class_counts(ch.with_class_name(points(spark, d)))


@query("point_chips", _PLACED + """SELECT p.point_id, count(*) AS n, CAST(sum(g.v) AS BIGINT) AS sum_v FROM pp p JOIN grid g
 ON abs(g."row" - p."row") <= 15 AND abs(g.col - p.col) <= 15 GROUP BY 1""", needs=("points", "grid"))
def point_chips(spark, d):
    from rasterloom.functions.geo import pixel_of

    row, col = pixel_of(F.col("x"), F.col("y"), AFFINE)
    placed = points(spark, d).select("point_id", row.alias("row"), col.alias("col"))
    return pt.chips(grid(spark, d), placed).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"))


@query("union_years", """SELECT "year", count(*) AS n, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM composite GROUP BY 1""", needs=("composite",))
def union_years(spark, d):
    from rasterloom.operators.features import combine_years

    c = composite(spark, d)
    both = combine_years({y: c.where(F.col("year") == y) for y in YEARS})
    return both.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("n_obs").alias("n_obs"))


_OK = "B2 IS NOT NULL AND B2 <= 10000 AND B3 <= 10000 AND B4 <= 10000 AND B8 <= 10000 AND B11 <= 10000 AND B12 <= 10000"


@query("common_valid", f"""SELECT "row", col FROM pixels WHERE "year" = 1996 AND {_OK} INTERSECT SELECT "row", col FROM pixels WHERE "year" = 1997 AND {_OK}""", needs=("pixels",))
def common_valid(spark, d):
    flagged = va.classify_validity(pixels(spark, d)).select("year", "row", "col", "valid")
    return va.common_valid(flagged.where("year = 1996"), flagged.where("year = 1997"))


@query("training_rows", """SELECT "year", count(*) AS n FROM labelled WHERE class <> 2 AND B2 IS NOT NULL GROUP BY 1""", needs=("labelled",))
def training_rows(spark, d):
    usable = va.labelled_and_finite(labelled(spark, d), cfg.FEATURES_9, nodata=2)
    return usable.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
