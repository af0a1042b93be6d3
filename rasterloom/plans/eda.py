"""Exploratory analysis of yearly scenes: quality, statistics, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg, sinks
from rasterloom.functions import geo
from rasterloom.functions.spectral import reflectance
from rasterloom.operators import features as fe, points as pt, sampling as sa, scenes as sc, statistics as st, validity as va
from rasterloom.session import checkpoint


def sampled_features(pixels: DataFrame, affine, aoi=None, cloud: DataFrame | None = None, per_year: int = cfg.SAMPLES_PER_YEAR):
    """Validity counts per year, and the feature table of a bounded sample of
    valid pixels."""
    masked = va.with_cloud_mask(pixels, cloud)
    inside = None
    if aoi is not None:
        x, y = geo.pixel_center(F.col("row"), F.col("col"), affine)
        inside = geo.is_inside(x, y, aoi)
    flagged = va.classify_validity(masked, cloud=F.col("flag"), inside=inside)
    counts = va.validity_counts(flagged, cap=per_year)
    valid = flagged.where("valid").select("year", "row", "col", *cfg.BANDS)
    sample = sa.sample_pixels(valid, per_year)
    scaled = sample.withColumns({b: reflectance(F.col(b)) for b in cfg.BANDS})
    return counts, fe.feature_table(scaled)


def run(
    pixels: DataFrame, out: str, affine, crs: str = "EPSG:32648", aoi=None, cloud: DataFrame | None = None,
    points: DataFrame | None = None, per_year: int = cfg.SAMPLES_PER_YEAR,
) -> dict[str, DataFrame]:
    """All tables of the analysis, written as CSV under `out`. The feature
    sample is materialised once; the pixel table is scanned for statistics,
    validity and sampling only."""
    meta = checkpoint(sc.raster_metadata(pixels, affine, cfg.BANDS, crs))
    stats = checkpoint(st.flag_out_of_range(st.band_statistics(pixels)))
    counts, sample = sampled_features(pixels, affine, aoi, cloud, per_year)
    sample = checkpoint(sample)
    quality = checkpoint(st.quality_table(pixels, va.any_out_of_range(cfg.BANDS)))
    tables = {
        "dataset_overview": meta, "data_quality_report": quality, "band_statistics": stats, "pixel_counts": counts,
        "feature_dataset": sample, "feature_statistics_overall": st.feature_statistics(sample, cfg.FEATURES_9),
        "feature_statistics_by_year": st.feature_statistics(sample, cfg.FEATURES_9, ["year"]),
        "temporal_index_trend": st.yearly_trend(sample), "correlation": st.correlation_matrix(sample, cfg.FEATURES_9),
        "boxplots": st.boxplot_statistics(sample, cfg.FEATURES_9, ["year"]),
        "histograms": st.equal_width_histogram(sample, cfg.FEATURES_9),
        "consistency": sc.consistency_issues(meta), "findings": st.findings(sample, quality, cfg.FEATURES_9),
        "readiness": st.readiness(pixels, sample, aoi is not None, points is not None),
    }
    if points is not None:
        tables.update(class_analysis(pixels, points, affine))
    for name, table in tables.items():
        sinks.write_csv(table, f"{out}/{name}")
    sinks.qc_report(meta, stats).write.mode("overwrite").json(f"{out}/qc_report")
    return tables


def class_analysis(pixels: DataFrame, points: DataFrame, affine) -> dict[str, DataFrame]:
    """Features of the latest year at labelled points, by class."""
    latest = pixels.agg(F.max("year")).first()[0]
    at = pt.extract_at_points(pixels.where(F.col("year") == latest), pt.validate_training_points(points), affine, cfg.BANDS)
    scaled = at.withColumns({b: reflectance(F.col(b)) for b in cfg.BANDS})
    table = checkpoint(fe.feature_table(scaled, latest, "class"))
    return {
        "class_features": table, "class_counts": st.class_counts(table),
        "class_boxplots": st.boxplot_statistics(table, cfg.INDICES, ["class_name"]),
    }


def yearly_summary(sample: DataFrame, counts: DataFrame, year: int, features: Sequence[str] = tuple(cfg.FEATURES_9)):
    """Feature summary and validity shares of one year."""
    summary = st.feature_statistics(sample.where(F.col("year") == year), features).select(
        "feature", "mean", "std", "min", "median", "max")
    shares = counts.where(F.col("year") == year).select(
        "year", *[(100.0 * F.col(f) / F.col("total")).alias(f"{f}_pct") for f in va.FLAGS])
    return summary, shares
