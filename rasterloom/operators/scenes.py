"""Scene catalogue and observation operators: which scenes, which pixels,
and the cloud-masked median composite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.columns import is_close
from rasterloom.functions.geo import polygon_edges
from rasterloom.functions.spectral import add_indices, reflectance, scl_clear



def dry_season(year: int) -> tuple[str, str]:
    """December of the previous year up to 30 April (excluded)."""
    return f"{year - 1}-12-01", f"{year}-04-30"


def calendar_year(year: int) -> tuple[str, str]:
    return f"{year}-01-01", f"{year + 1}-01-01"


def window_year(ts: Column, years: Sequence[int], window=dry_season) -> Column:
    """Study year whose half-open window holds the timestamp, else NULL."""
    expr = None
    for year in years:
        start, end = (F.lit(s) for s in window(year))  # typed like ts by Spark
        hit = (ts >= start) & (ts < end)
        expr = F.when(hit, F.lit(year)) if expr is None else expr.when(hit, F.lit(year))
    return expr


def within_windows(ts: Column, years: Sequence[int], window=dry_season) -> Column:
    """The same windows as an OR of ranges, which reaches the Parquet scan."""
    hit = None
    for year in years:
        start, end = (F.lit(s) for s in window(year))  # typed like ts by Spark
        one = (ts >= start) & (ts < end)
        hit = one if hit is None else hit | one
    return hit


def select_scenes(
    scenes: DataFrame,
    years: Sequence[int],
    max_cloud: float = cfg.MAX_SCENE_CLOUD,
    window=dry_season,
    bounds: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Scenes inside a study window, below the cloud limit and, if the
    catalogue has a footprint envelope, overlapping the bounds."""
    ts = F.col("ts")
    out = scenes.where(within_windows(ts, years, window) & (F.col("cloud_pct") < max_cloud))
    if bounds is not None:
        xmin, ymin, xmax, ymax = bounds
        out = out.where(
            (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin)
            & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
        )
    return out.withColumn("year", window_year(ts, years, window))


def select_observations(obs: DataFrame, scenes: DataFrame, years: Sequence[int], **options) -> DataFrame:
    """Observations of the selected scenes with their study year. The time
    range is also applied to the observations themselves, so row groups are
    pruned before the join; the scene side is small and Spark broadcasts it
    when its size allows."""
    picked = select_scenes(scenes, years, **options).select("scene_id", "year")
    ranged = obs.where(within_windows(F.col("ts"), years, options.get("window", dry_season)))
    return ranged.join(picked, "scene_id")


def scene_count(scenes: DataFrame, years: Sequence[int], **options) -> DataFrame:
    return (
        select_scenes(scenes, years, **options)
        .groupBy("year")
        .agg(F.countDistinct("scene_id").alias("n_scenes"))
    )


def mask_clouds(obs: DataFrame, scl: str = "scl") -> DataFrame:
    return obs.where(scl_clear(F.col(scl)))


def median_composite(
    obs: DataFrame,
    keys: Sequence[str] = ("year", "row", "col"),
    bands: Sequence[str] = tuple(cfg.BANDS),
    scale: bool = True,
) -> DataFrame:
    """Per-pixel median over the masked observations, with the number of
    observations next to it. Exact, one shuffle, one method for all pixels.

    The state of a pixel is a counter for each distinct digital number (at
    most 10 001 a band, whatever the number of observations), and counters
    are combined before the shuffle: a pixel with a third of all rows sends
    one counter from each task."""
    def finish(c):
        return reflectance(c) if scale else c

    return obs.groupBy(*keys).agg(*[finish(F.median(b)).alias(b) for b in bands], F.count(F.lit(1)).alias("n_obs"))


def build_composite(obs, scenes, years, **options) -> DataFrame:
    """Scene selection, cloud mask, median, reflectance and indices. No job
    runs before the result is asked for."""
    return add_indices(median_composite(mask_clouds(select_observations(obs, scenes, years, **options))))


def sensor_ndbi(obs: DataFrame, swir: str, nir: str, keys=("year", "row", "col")) -> DataFrame:
    """Median composite of two bands and their NDBI, for either sensor."""
    from rasterloom.functions.spectral import ndbi

    both = median_composite(obs, keys, [swir, nir], scale=False)
    return both.select(*keys, ndbi(F.col(swir), F.col(nir)).alias("ndbi"))


def years_available(years: DataFrame, scenes: DataFrame) -> DataFrame:
    return years.join(scenes.select("year").distinct(), "year", "left_semi")


def years_missing(years: DataFrame, scenes: DataFrame) -> DataFrame:
    return years.join(scenes.select("year").distinct(), "year", "left_anti")


def representative_years(years: DataFrame) -> DataFrame:
    """First, middle and last study year; every year if there are at most 3.
    One row per year, so the single window partition is tiny."""
    w = Window.partitionBy(F.lit(1))
    ranked = years.select("year").distinct().withColumns({
        "i": F.row_number().over(w.orderBy("year")) - 1,
        "n": F.count(F.lit(1)).over(w),
    })
    middle = F.floor(F.col("n") / 2)
    keep = (F.col("n") <= 3) | (F.col("i") == 0) | (F.col("i") == middle) | (F.col("i") == F.col("n") - 1)
    return ranked.where(keep).select("year")


def best_scene_per_year(scenes: DataFrame, aoi: Sequence[tuple[float, float]]) -> DataFrame:
    """Least cloudy scene per year among those whose footprint envelope
    contains the whole area of interest."""
    xs, ys = [p[0] for p in aoi], [p[1] for p in aoi]
    contains = (
        (F.col("xmin") <= min(xs)) & (F.col("xmax") >= max(xs))
        & (F.col("ymin") <= min(ys)) & (F.col("ymax") >= max(ys))
    )
    # min over a struct is a map-side aggregate: no per-year sort of scenes
    best = F.min(F.struct("cloud_pct", "scene_id")).alias("best")
    return (
        scenes.where(contains)
        .groupBy("year")
        .agg(best)
        .select("year", F.col("best.scene_id"), F.col("best.cloud_pct"))
    )


def pinned_scenes(scenes: DataFrame, pins: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Look up scenes by a (year, scene_id) list; optionally the asset name
    of every band."""
    found = scenes.join(pins, ["year", "scene_id"])
    return found if assets is None else found.join(assets, "scene_id", "left")


def raster_metadata(pixels: DataFrame, affine, bands: Sequence[str], crs: str) -> DataFrame:
    """Structural metadata per year derived from the pixel table."""
    a, _, c, _, e, f = affine
    width, height = F.col("width"), F.col("height")
    return (
        pixels.groupBy("year")
        .agg(
            (F.max("col") + 1).alias("width"),
            (F.max("row") + 1).alias("height"),
        )
        .withColumns({
            "band_count": F.lit(len(bands)),
            "crs": F.lit(crs),
            "resolution_x": F.lit(abs(float(a))),
            "resolution_y": F.lit(abs(float(e))),
            "xmin": F.lit(float(c)),
            "ymax": F.lit(float(f)),
            "xmax": F.lit(float(c)) + width * F.lit(float(a)),
            "ymin": F.lit(float(f)) + height * F.lit(float(e)),
            "total_pixels": width.cast("bigint") * height * len(bands),
        })
    )


def consistency_issues(metadata: DataFrame) -> DataFrame:
    """One message row per deviation of a year from the first year. The
    metadata table has one row per year."""
    first = Window.partitionBy(F.lit(1)).orderBy("year")
    cols = ["year", "band_count", "crs", "resolution_x"]
    m = metadata.select(
        *cols, *[F.first(c).over(first).alias(f"ref_{c}") for c in cols]
    ).where(F.col("year") > F.col("ref_year"))
    c = F.col
    def differs(kind: str, form: str, name: str) -> Column:
        return F.format_string(f"{kind} {form} instead of {form}", c(name), c(f"ref_{name}"))

    text = {
        "band_count": differs("bands:", "%d", "band_count"), "crs": differs("crs:", "%s", "crs"),
        "resolution": differs("cell size:", "%.2f", "resolution_x"),
    }
    checks = F.array(
        F.when(c("band_count") != c("ref_band_count"), text["band_count"]),
        F.when(~c("crs").eqNullSafe(c("ref_crs")), text["crs"]),
        F.when(~is_close(c("resolution_x"), c("ref_resolution_x")), text["resolution"]),
    )
    return m.select("year", F.explode(F.array_compact(checks)).alias("issue"))


def same_grid(metadata: DataFrame) -> None:
    """Fail early unless all years share one grid."""
    grids = metadata.select("width", "height", "xmin", "ymax", "resolution_x", "resolution_y").distinct()
    if len(grids.take(2)) > 1:
        raise ValueError("years have different pixel grids")


def bounds_of(ring) -> tuple[float, float, float, float]:
    edges = polygon_edges([ring])
    xs, ys = [e[0] for e in edges], [e[1] for e in edges]
    return min(xs), min(ys), max(xs), max(ys)
