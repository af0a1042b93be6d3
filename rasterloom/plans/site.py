"""Single-scene analysis around a site: edges, texture, feature-set
comparison, shared class map, zones, road distance, straight lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions import geo
from rasterloom.functions.spectral import add_indices
from rasterloom.operators import (
    classify as cl, components as co, edges as ed, focal, hough as ho, sampling as sa, texture as tx, validity as va,
    vectors as ve, zones as zo,
)
from rasterloom.session import checkpoint

FEATURES_11 = cfg.FEATURES_9 + cfg.EDGE_FEATURES
FEATURES_15 = FEATURES_11 + cfg.TEXTURE_FEATURES


def scene_features(bands: DataFrame, extent: focal.Extent, inside=None, cloud=None, tile: int = focal.TILE):
    """(year, row, col) with validity, indices, edge density, gradient and
    texture; and the edge pixels and thresholds per year. `bands` is a dense
    table of scaled reflectance."""
    keys = ["year"]
    b = checkpoint(va.scene_valid(add_indices(bands, "clamp"), inside=inside, cloud=cloud))
    edges, limits = ed.canny(b, "NDBI", extent, keys=keys, tile=tile, dense=True)
    edges = checkpoint(edges)
    flags = ed.edge_flags(b.select(*keys, "row", "col"), edges, keys)
    density = ed.edge_density(flags, extent, keys, tile, dense=True)
    sobel = ed.edge_maps(b, "NDBI", extent, keys=keys, tile=tile, dense=True)
    sobel = sobel.select(*keys, "row", "col", (F.col("sobel") / 8).alias("sobel_gradient"))
    grey = b.select(*keys, "row", "col", tx.quantise(F.col("B8")).alias("q"))
    texture = tx.glcm(grey, "q", extent, keys, tile, dense=True)
    at = [*keys, "row", "col"]
    return b.join(density, at).join(sobel, at).join(texture, at), edges, limits


def class_maps(features: DataFrame, labels: DataFrame, reference_year: int, trees: int = cfg.N_TREES, per_class: int = cfg.SAMPLES_PER_CLASS, minimum: int = cfg.MIN_SAMPLES_PER_CLASS):
    """Compare 9, 11 and 15 features on the reference year, then classify all
    years with the winner."""
    ground = features.where((F.col("year") == reference_year) & F.col("valid")).join(labels, ["row", "col"])
    usable = va.labelled_and_finite(ground, cfg.FEATURES_9)
    eligible = usable.where((F.col("class") != 0) | (F.col("NDWI") > cfg.WATER_NDWI_MIN))
    sample = checkpoint(sa.stratified_sample(eligible, per_class, features=FEATURES_15))
    sets = {"nine": cfg.FEATURES_9, "eleven": FEATURES_11, "fifteen": FEATURES_15}
    scores, models = cl.compare_feature_sets(sample, sets, trees=trees, minimum=minimum)
    scores = checkpoint(scores)
    winner = cl.best_set(scores.orderBy(F.desc("oa"), F.desc("kappa"), "n_features"))
    classified = cl.classify(models[winner], features.where("valid")).select("year", "row", "col", "class")
    return scores, classified


def zone_tables(classified: DataFrame, years: Sequence[int], affine, center, roads: DataFrame | None, extent: focal.Extent):
    """Ring, direction and road-distance tables on pixels valid in all
    years."""
    n = len(years)
    common = classified.groupBy("row", "col").agg(F.countDistinct("year").alias("n")).where(F.col("n") == n).select("row", "col")
    both = classified.join(common, ["row", "col"], "left_semi")
    ha = geo.pixel_area_ha(affine)
    rings = zo.ring_direction_table(zo.with_zone(both, affine, center), ha)
    if roads is None:
        return rings, None
    cells = ve.rasterize_lines(roads, affine)
    grid = common.select("row", "col")
    d = ve.nearest_distance(grid, cells, extent, (abs(affine[4]), abs(affine[0])))
    return rings, zo.distance_band_table(both.join(d, ["row", "col"]), "distance", ha)


def line_analysis(edges: DataFrame, classified: DataFrame, fence, affine, extent: focal.Extent, min_length_m: float = cfg.MIN_SEGMENT_M):
    """Straight lines inside the fence and the shape of the largest built-up
    component, one summary row per year."""
    x, y = geo.pixel_center(F.col("row"), F.col("col"), affine)
    inside = geo.is_inside(x, y, fence)
    res = abs(affine[0])
    e = checkpoint(edges.where(inside))
    lines = checkpoint(ho.peaks(ho.votes(e, ["year"]), ["year"]))
    segs = ho.all_segments(e, ["year"], min_length=round(min_length_m / res), resolution=res)
    segs = checkpoint(segs.withColumn("seg", F.concat_ws("-", "t", "rho", "row1", "col1", "row2", "col2")))
    grouped = checkpoint(ho.group_segments(ho.hit_rate(segs, classified)))
    built = classified.where((F.col("class") == cfg.BUILT_UP) & inside)
    axis = co.largest_component(co.connected_components(built, extent, ["year"]), ["year"])
    return ho.bearing_gap(ho.line_summary(grouped, layers=classified.select("year"), edges=e, peaks=lines), axis), grouped, axis, lines
