"""Scenes, masks, composites, indices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import (
    AFFINE, AOI, YEARS, _SEASON, composite, landcover, landsat, obs, observations, pixels, query, rd, read,
    rounded, rq, scenes,
)
from rasterloom.functions import spectral as sp
from rasterloom.functions.geo import is_inside, pixel_center
from rasterloom.operators import change, scenes as sc, statistics as st, validity as va
from rasterloom.session import ensure_checkpoint_dir
from rasterloom.streaming import composites as cs

B = cfg.BANDS


@query("composite_trend", f"""
SELECT "year", count(*) AS n_pixels, {rq('avg(NDVI)')} AS mean_NDVI, {rq('avg(NDBI)')} AS mean_NDBI,
       {rq('avg(NDWI)')} AS mean_NDWI,
       {rq('100.0::DOUBLE * avg(CASE WHEN NDBI IS NULL THEN NULL WHEN NDBI > 0 THEN 1 ELSE 0 END)')} AS positive_pct
FROM composite GROUP BY "year" """, needs=("composite",))
def composite_trend(spark, d):
    c = composite(spark, d)
    agg = c.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        *[F.avg(i).alias(f"mean_{i}") for i in cfg.INDICES],
        (100.0 * F.avg((F.col("NDBI") > 0).cast("int"))).alias("positive_pct"),
    )
    return rounded(agg, *[f"mean_{i}" for i in cfg.INDICES], "positive_pct")


@query("composite_median", f"""
SELECT "year", "row", col, n_obs, {", ".join(f'{rq(b)} AS {b}' for b in cfg.FEATURES_9)} FROM composite
""", needs=("composite",))
def composite_median(spark, d):
    return rounded(composite(spark, d), *cfg.FEATURES_9)


@query("composite_in_batches", f"""
SELECT "year", "row", col, n_obs, {", ".join(f'{rq(b)} AS {b}' for b in B)} FROM composite
""", needs=("composite",))
def composite_in_batches(spark, d):
    """The composite from counters that three batches add up to, months of
    a year in turn, so that most pixels are touched by late rows."""
    path = f"{ensure_checkpoint_dir(spark)}/composite-{uuid.uuid4().hex}"
    seen = sc.mask_clouds(observations(spark, d))
    for i in range(3):
        cs.add_observations(seen.where(F.month("ts") % 3 == i), path, i)
    return rounded(cs.current_composite(spark, path), *B)


@query("calendar_composite", f"""
SELECT CAST(year(ts) AS INT) AS "year", "row", col, {rq('median(B11) / 10000.0::DOUBLE')} AS B11,
       {rq('median(B8) / 10000.0::DOUBLE')} AS B8, count(*) AS n_obs
FROM obs WHERE scene_id IN (SELECT scene_id FROM scenes WHERE cloud_pct < 10) AND year(ts) BETWEEN 1996 AND 2001
GROUP BY 1, 2, 3""", needs=("obs", "scenes"))
def calendar_composite(spark, d):
    """The older draft: calendar years, strict cloud limit, no pixel mask."""
    chosen = sc.select_observations(
        obs(spark, d), scenes(spark, d), YEARS, max_cloud=10, window=sc.calendar_year)
    return rounded(sc.median_composite(chosen, bands=["B11", "B8"]), "B11", "B8")


@query("scene_count", """
SELECT "year", count(DISTINCT scene_id) AS n_scenes FROM picked GROUP BY "year" """, needs=("picked",))
def scene_count(spark, d):
    return sc.scene_count(scenes(spark, d), YEARS)


@query("scene_selection", f"""
SELECT scene_id, CAST("year" AS INT) AS "year", cloud_pct FROM picked
WHERE xmin <= 500 AND xmax >= 100 AND ymin <= 50 AND ymax >= 10""", needs=("picked",))
def scene_selection(spark, d):
    picked = sc.select_scenes(scenes(spark, d), YEARS, bounds=(100, 10, 500, 50))
    return picked.select("scene_id", "year", "cloud_pct")


@query("best_scene", """
SELECT "year", scene_id, cloud_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY "year" ORDER BY cloud_pct, scene_id) AS rn
  FROM picked WHERE xmin <= 100 AND xmax >= 500 AND ymin <= 10 AND ymax >= 50) WHERE rn = 1""", needs=("picked",))
def best_scene(spark, d):
    corners = [(100, 10), (500, 10), (500, 50), (100, 50)]
    return sc.best_scene_per_year(sc.select_scenes(scenes(spark, d), YEARS), corners)


@query("pinned_scenes", """
SELECT p."year", p.scene_id, s.cloud_pct FROM
  (SELECT "year", min(scene_id) AS scene_id FROM picked GROUP BY "year") p JOIN picked s
  ON p."year" = s."year" AND p.scene_id = s.scene_id""", needs=("picked",))
def pinned_scenes(spark, d):
    picked = sc.select_scenes(scenes(spark, d), YEARS)
    pins = picked.groupBy("year").agg(F.min("scene_id").alias("scene_id"))
    return sc.pinned_scenes(picked, pins).select("year", "scene_id", "cloud_pct")


@query("years_available", """
SELECT y AS "year" FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) + 2 AS y FROM orders)
WHERE y IN (SELECT "year" FROM picked)""", needs=("picked",))
def years_available(spark, d):
    years = read(spark, d, "orders").select((F.year("o_orderdate") + 2).alias("year")).distinct()
    return sc.years_available(years, sc.select_scenes(scenes(spark, d), YEARS))


@query("years_missing", """
SELECT y AS "year" FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) + 2 AS y FROM orders)
WHERE y NOT IN (SELECT "year" FROM picked)""", needs=("picked",))
def years_missing(spark, d):
    years = read(spark, d, "orders").select((F.year("o_orderdate") + 2).alias("year")).distinct()
    return sc.years_missing(years, sc.select_scenes(scenes(spark, d), YEARS))


@query("representative_years", """
SELECT CAST("year" AS INT) AS "year" FROM (SELECT "year", row_number() OVER (ORDER BY "year") - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT "year" FROM picked)) WHERE n <= 3 OR i = 0 OR i = floor(n / 2) OR i = n - 1""", needs=("picked",))
def representative_years(spark, d):
    return sc.representative_years(sc.select_scenes(scenes(spark, d), YEARS))


@query("dry_season_window", f"""
SELECT CAST(CASE {_SEASON} END AS INT) AS "year", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM obs GROUP BY 1""", needs=("obs",))
def dry_season_window(spark, d):
    return obs(spark, d).groupBy(sc.window_year(F.col("ts"), YEARS).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("scl_mask", """
SELECT scl, count(*) AS n, sum(B2)::BIGINT AS sum_b2 FROM obs WHERE scl NOT IN (3, 8, 9, 10) GROUP BY scl""", needs=("obs",))
def scl_mask(spark, d):
    return sc.mask_clouds(obs(spark, d)).groupBy("scl").agg(F.count(F.lit(1)).alias("n"), F.sum("B2").alias("sum_b2"))


@query("cloud_share", f"""
SELECT scene_id, {rq('100.0::DOUBLE * avg(CASE WHEN scl IN (3, 8, 9, 10) THEN 1 ELSE 0 END)')} AS cloud_pct
FROM obs GROUP BY scene_id""", needs=("obs",))
def cloud_share(spark, d):
    return rounded(va.cloud_share(obs(spark, d), ~sp.scl_clear(F.col("scl"))), "cloud_pct")


@query("qa_bitmask", """
SELECT "year", count(*) AS n, sum(sr_b5)::BIGINT AS sum_b5 FROM landsat
WHERE (qa_pixel & 8) = 0 AND (qa_pixel & 16) = 0 GROUP BY "year" """, needs=("landsat",))
def qa_bitmask(spark, d):
    return landsat(spark, d).where(sp.qa_clear(F.col("qa_pixel"))).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sr_b5").alias("sum_b5"))


@query("landsat_scaling", f"""
SELECT "row", col, "year", qa_pixel, {rq('sr_b5 * 0.0000275::DOUBLE - 0.2::DOUBLE', 8)} AS sr_b5,
       {rq('sr_b6 * 0.0000275::DOUBLE - 0.2::DOUBLE', 8)} AS sr_b6 FROM landsat""", needs=("landsat",))
def landsat_scaling(spark, d):
    return rounded(sp.landsat_reflectance(landsat(spark, d)), "sr_b5", "sr_b6", digits=8)


@query("spectral_indices", f"""
SELECT "row", col, ts, scl, {rq('(B8 - B4) / nullif(B8 + B4, 0)')} AS NDVI,
       {rq('(B11 - B8) / nullif(B11 + B8, 0)')} AS NDBI, {rq('(B3 - B8) / nullif(B3 + B8, 0)')} AS NDWI FROM obs""", needs=("obs",))
def spectral_indices(spark, d):
    return rounded(sp.add_indices(obs(spark, d)).select("row", "col", "ts", "scl", *cfg.INDICES), *cfg.INDICES)


@query("clamped_indices", f"""
SELECT "row", col, ts, {rq('(B8 - B4) / greatest(CAST(B8 + B4 AS DOUBLE), 0.000001::DOUBLE)')} AS NDVI FROM obs""", needs=("obs",))
def clamped_indices(spark, d):
    return rounded(sp.add_indices(obs(spark, d), mode="clamp").select("row", "col", "ts", "NDVI"), "NDVI")


@query("safe_divide", f"""
SELECT B4 + B8 AS den, count(*) AS n,
       {rq('sum(CASE WHEN B4 + B8 = 0 THEN -1.0::DOUBLE ELSE (B8 - B4) / CAST(B4 + B8 AS DOUBLE) END)')} AS total
FROM obs GROUP BY 1""", needs=("obs",))
def safe_divide(spark, d):
    o = obs(spark, d)
    ratio = sp.safe_divide(F.col("B8") - F.col("B4"), F.col("B4") + F.col("B8"), fill=-1.0)
    return o.groupBy((F.col("B4") + F.col("B8")).alias("den")).agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum(ratio)).alias("total"))


def _remap_sql(scheme):
    mapping, default = cfg.LANDCOVER_SCHEMES[scheme]
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in mapping.items())
    return f"CASE wc {whens} ELSE {'NULL' if default is None else default} END"


@query("remap_classes", f"""
SELECT wc, CAST({_remap_sql('server')} AS INT) AS server, CAST({_remap_sql('local')} AS INT) AS local,
       CAST({_remap_sql('full')} AS INT) AS "full", count(*) AS n FROM landcover GROUP BY wc""", needs=("landcover",))
def remap_classes(spark, d):
    counts = landcover(spark, d).groupBy("wc").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({s: change.remap_landcover(F.col("wc"), s) for s in cfg.LANDCOVER_SCHEMES})


@query("label_histogram", f"""
SELECT CAST({_remap_sql('server')} AS INT) AS class, count(*) AS n FROM landcover GROUP BY 1""", needs=("landcover",))
def label_histogram(spark, d):
    return change.class_histogram(landcover(spark, d).withColumn("class", change.remap_landcover(F.col("wc"))))


@query("label_stack", f"""
SELECT c."year", c."row", c.col, {rq('c.NDVI')} AS NDVI, CAST({_remap_sql('server')} AS INT) AS class
FROM composite c JOIN landcover l ON c."row" = l."row" AND c.col = l.col""", needs=("composite", "landcover"))
def label_stack(spark, d):
    """Composite and label raster stacked on the pixel."""
    lab = landcover(spark, d).select("row", "col", change.remap_landcover(F.col("wc")).alias("class"))
    stacked = composite(spark, d).join(lab, ["row", "col"])
    return rounded(stacked.select("year", "row", "col", "NDVI", "class"), "NDVI")


_INSIDE = "(" + " + ".join(
    f"(CASE WHEN ({y1} > y) <> ({y2} > y) AND x < {x1} + (y - {y1}) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE THEN 1 ELSE 0 END)"
    for ring in AOI for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2
) + ") % 2 = 1"
_XY = '600000.0::DOUBLE + (col + 0.5::DOUBLE) * 10.0::DOUBLE AS x, 1200000.0::DOUBLE - ("row" + 0.5::DOUBLE) * 10.0::DOUBLE AS y'


def _flagged(spark, d):
    x, y = pixel_center(F.col("row"), F.col("col"), AFFINE)
    cloud = (F.col("row") * 7 + F.col("col") * 3 + F.col("year")) % 11 == 0
    return va.classify_validity(pixels(spark, d), cloud=cloud, inside=is_inside(x, y, AOI))


@query("pixel_validity", f"""
, xy AS (SELECT *, {_XY} FROM pixels), flags AS (
  SELECT "year", (B2 IS NULL) AS missing, coalesce(B2 > 10000 OR B3 > 10000 OR B4 > 10000 OR B8 > 10000 OR B11 > 10000 OR B12 > 10000
         OR B2 < 0 OR B3 < 0 OR B4 < 0 OR B8 < 0 OR B11 < 0 OR B12 < 0, false) AS invalid_range,
         (("row" * 7 + col * 3 + "year") % 11 = 0) AS cloud, NOT ({_INSIDE}) AS outside_aoi FROM xy)
SELECT "year", count(*) AS total, CAST(count_if(missing) AS BIGINT) AS missing, CAST(count_if(invalid_range) AS BIGINT) AS invalid_range, CAST(count_if(cloud) AS BIGINT) AS cloud,
       CAST(count_if(outside_aoi) AS BIGINT) AS outside_aoi, CAST(count_if(NOT (missing OR invalid_range OR cloud OR outside_aoi)) AS BIGINT) AS valid,
       least(CAST(count_if(NOT (missing OR invalid_range OR cloud OR outside_aoi)) AS BIGINT), 1000) AS sampled
FROM flags GROUP BY "year" """, needs=("pixels",))
def pixel_validity(spark, d):
    counts = va.validity_counts(_flagged(spark, d), cap=1000)
    return counts.withColumns({c: F.col(c).cast("bigint") for c in counts.columns if c != "year"})


@query("aoi_filter", f"""
, xy AS (SELECT *, {_XY} FROM grid) SELECT "row", col, v FROM xy WHERE {_INSIDE}""", needs=("grid",))
def aoi_filter(spark, d):
    from rasterloom.catalog.base import grid
    from rasterloom.operators.polygons import clip_to_polygon

    return clip_to_polygon(grid(spark, d), AOI, AFFINE).select("row", "col", "v")


@query("scene_valid", """
SELECT "year", count(*) AS n, CAST(count_if(coalesce(B2 > 0 AND B2 <= 1 AND B3 > 0 AND B3 <= 1 AND B4 > 0 AND B4 <= 1 AND B8 > 0 AND B8 <= 1
       AND B11 > 0 AND B11 <= 1 AND B12 > 0 AND B12 <= 1, false)) AS BIGINT) AS n_valid FROM composite GROUP BY "year" """, needs=("composite",))
def scene_valid(spark, d):
    return va.scene_valid(composite(spark, d)).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


@query("cloud_mask_join", """
SELECT p."year", count(*) AS n, CAST(count_if(coalesce(m.flag, 0) <> 0) AS BIGINT) AS n_cloud FROM pixels p LEFT JOIN
  (SELECT "row", col, "year", max(CASE WHEN (qa_pixel & 24) <> 0 THEN 1 ELSE 0 END) AS flag FROM landsat GROUP BY 1, 2, 3) m
  ON p."year" = m."year" AND p."row" = m."row" AND p.col = m.col GROUP BY 1""", needs=("pixels", "landsat"))
def cloud_mask_join(spark, d):
    cloud = landsat(spark, d).groupBy("row", "col", "year").agg(
        F.max((~sp.qa_clear(F.col("qa_pixel"))).cast("int")).alias("flag"))
    return va.with_cloud_mask(pixels(spark, d), cloud).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("n_cloud"))


@query("raster_metadata", """
SELECT "year", max(col) + 1 AS width, max("row") + 1 AS height, CAST(6 AS INT) AS band_count, 'EPSG:32648' AS crs, 10.0::DOUBLE AS resolution_x,
       10.0::DOUBLE AS resolution_y, 600000.0::DOUBLE AS xmin, 1200000.0::DOUBLE AS ymax,
       600000.0::DOUBLE + (max(col) + 1) * 10.0::DOUBLE AS xmax, 1200000.0::DOUBLE - (max("row") + 1) * 10.0::DOUBLE AS ymin,
       CAST((max(col) + 1) AS BIGINT) * (max("row") + 1) * 6 AS total_pixels FROM pixels GROUP BY "year" """, needs=("pixels",))
def raster_metadata(spark, d):
    return sc.raster_metadata(pixels(spark, d), AFFINE, B, "EPSG:32648")


@query("year_consistency", """
, m AS (SELECT "year", 5 + CAST("year" % 2 AS INT) AS band_count, CASE WHEN "year" = 1999 THEN 'EPSG:4326' ELSE 'EPSG:32648' END AS crs,
        CASE WHEN "year" > 1999 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS res FROM (SELECT DISTINCT "year" FROM picked)),
 f AS (SELECT * FROM m ORDER BY "year" LIMIT 1)
SELECT CAST("year" AS INT) AS "year", issue FROM (
 SELECT m."year", format('bands: {} instead of {}', m.band_count, f.band_count) AS issue
   FROM m, f WHERE m.band_count <> f.band_count
 UNION ALL SELECT m."year", format('crs: {} instead of {}', m.crs, f.crs) FROM m, f WHERE m.crs <> f.crs
 UNION ALL SELECT m."year", format('cell size: {:.2f} instead of {:.2f}', m.res, f.res) FROM m, f
   WHERE abs(m.res - f.res) > 0.00000001 + 0.001 * f.res)""", needs=("picked",))
def year_consistency(spark, d):
    years = sc.select_scenes(scenes(spark, d), YEARS).select("year").distinct()
    meta = years.select(
        "year", (5 + F.col("year") % 2).cast("int").alias("band_count"),
        F.when(F.col("year") == 1999, "EPSG:4326").otherwise("EPSG:32648").alias("crs"),
        F.when(F.col("year") > 1999, 10.0).otherwise(20.0).alias("resolution_x"),
    )
    return sc.consistency_issues(meta)


@query("positive_share", f"""
SELECT "year", {rq('100.0::DOUBLE * avg(CASE WHEN NDBI IS NULL THEN NULL WHEN NDBI > 0 THEN 1 ELSE 0 END)')} AS positive_pct
FROM composite GROUP BY "year" """, needs=("composite",))
def positive_share(spark, d):
    return rounded(st.positive_share(composite(spark, d)), "positive_pct")
