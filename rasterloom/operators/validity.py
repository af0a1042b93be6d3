"""Pixel validity: missing, out of range, cloudy, outside, valid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg

FLAGS = ["missing", "invalid_range", "cloud", "outside_aoi", "valid"]


def any_null(bands: Sequence[str]) -> Column:
    return reduce(or_, [F.col(b).isNull() for b in bands])


def any_out_of_range(bands, lo=cfg.VALID_RAW_MIN, hi=cfg.VALID_RAW_MAX) -> Column:
    return F.coalesce(reduce(or_, [(F.col(b) < lo) | (F.col(b) > hi) for b in bands]), F.lit(False))


def classify_validity(
    df: DataFrame,
    bands: Sequence[str] = tuple(cfg.BANDS),
    cloud: Column | None = None,
    inside: Column | None = None,
) -> DataFrame:
    """Add the five flags. They may overlap; only `valid` excludes the rest."""
    false = F.lit(False)
    missing = any_null(bands)
    cloudy = false if cloud is None else F.coalesce(cloud, false)
    outside = false if inside is None else ~F.coalesce(inside, false)
    flags = df.withColumns({
        "missing": missing,
        "invalid_range": any_out_of_range(bands) & ~missing,
        "cloud": cloudy,
        "outside_aoi": outside,
    })
    bad = reduce(or_, [F.col(c) for c in FLAGS[:-1]])
    return flags.withColumn("valid", ~bad)


def validity_counts(flagged: DataFrame, by: Sequence[str] = ("year",), cap: int | None = cfg.SAMPLES_PER_YEAR) -> DataFrame:
    """Total and per-flag counts, and how many pixels a sample would hold."""
    counts = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(f)).alias(f) for f in FLAGS],
    )
    if cap is None:
        return counts
    return counts.withColumn("sampled", F.least(F.col("valid"), F.lit(cap)))


def scene_valid(df: DataFrame, bands=tuple(cfg.BANDS), inside: Column | None = None, cloud: Column | None = None) -> DataFrame:
    """Single-scene rule: inside, not cloudy, every scaled band in (0, 1]."""
    ok = reduce(and_, [(F.col(b) > 0) & (F.col(b) <= 1) for b in bands])
    if inside is not None:
        ok = ok & inside
    if cloud is not None:
        ok = ok & ~F.coalesce(cloud, F.lit(False))
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def with_cloud_mask(pixels: DataFrame, cloud: DataFrame | None, keys=("year", "row", "col")) -> DataFrame:
    """Attach the optional cloud raster; no raster or no row means clear."""
    if cloud is None:
        return pixels.withColumn("flag", F.lit(False))
    mask = cloud.select(*keys, (F.col("flag") != 0).alias("flag"))
    joined = pixels.join(mask, list(keys), "left")
    return joined.withColumn("flag", F.coalesce("flag", F.lit(False)))


def cloud_share(df: DataFrame, flag: Column, by=("scene_id",)) -> DataFrame:
    return df.groupBy(*by).agg((100.0 * F.avg(flag.cast("int"))).alias("cloud_pct"))


def labelled_and_finite(df: DataFrame, features: Sequence[str], label: str = "class", nodata: int = 255) -> DataFrame:
    """Rows usable for training: a real label and no missing feature."""
    return df.where(F.col(label) != nodata).dropna(subset=list(features))


def common_valid(a: DataFrame, b: DataFrame, keys=("row", "col")) -> DataFrame:
    """Pixels valid at both dates (set intersection of the valid keys)."""
    k = list(keys)
    return a.where("valid").select(*k).join(b.where("valid").select(*k), k, "left_semi")
