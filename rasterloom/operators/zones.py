"""Rings, compass sectors and distance bands around fixed places."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions import geo


def with_zone(df: DataFrame, affine, center: tuple[float, float], edges: Sequence[float] = tuple(cfg.RINGS_M)) -> DataFrame:
    """Add distance, ring label and compass sector of the pixel centre."""
    x, y = geo.pixel_center(F.col("row"), F.col("col"), affine)
    dx, dy = x - F.lit(float(center[0])), y - F.lit(float(center[1]))
    d = geo.hypot(dx, dy)
    return df.withColumns({"dist": d, "ring": geo.band_label(d, edges), "sector": geo.compass_sector(dx, dy)})


def _zone_frame(df: DataFrame, by: Sequence[str], cells: Column) -> DataFrame:
    """Every zone of every group, so that empty zones are reported."""
    return df.select(*by).distinct().withColumn("z", F.explode(cells)).select(*by, "z.*")


def _built_share(counted: DataFrame, pixel_ha: float, keys: Sequence[str]) -> DataFrame:
    n, built = F.coalesce("n", F.lit(0)), F.coalesce("n_built", F.lit(0))
    return counted.select(
        *keys, (n * F.lit(pixel_ha)).alias("zone_ha"), (built * F.lit(pixel_ha)).alias("builtup_ha"),
        F.coalesce(100.0 * built / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("builtup_pct"),
    )


def ring_direction_table(zoned: DataFrame, pixel_ha: float, edges=tuple(cfg.RINGS_M), by=("year",), cls: int = cfg.BUILT_UP) -> DataFrame:
    """Zone and built-up area per ring and direction, 24 rows per year."""
    keys = [*by, "ring", "sector"]
    counts = zoned.where(F.col("ring").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == cls).alias("n_built")
    )
    cells = F.array(*[
        F.struct(F.lit(r).alias("ring"), F.lit(s).alias("sector"))
        for r in geo.band_labels(edges) for s in range(8)
    ])
    frame = _zone_frame(zoned, by, cells)
    table = _built_share(frame.join(counts, keys, "left"), pixel_ha, keys)
    names = F.array(*[F.lit(n) for n in cfg.COMPASS])
    return table.withColumn("direction", F.element_at(names, F.col("sector") + 1))


def distance_band_table(df: DataFrame, distance: str, pixel_ha: float, edges=tuple(cfg.ROAD_BANDS_M), by=("year",), cls: int = cfg.BUILT_UP) -> DataFrame:
    """The same table over distance bands, the last one open-ended."""
    keys = [*by, "band"]
    banded = df.withColumn("band", geo.band_label(F.col(distance), edges, open_end=True))
    counts = banded.where(F.col("band").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == cls).alias("n_built")
    )
    cells = F.array(*[F.struct(F.lit(b).alias("band")) for b in geo.band_labels(edges, open_end=True)])
    return _built_share(_zone_frame(df, by, cells).join(counts, keys, "left"), pixel_ha, keys)


def zone_rollup(zones: DataFrame) -> DataFrame:
    """Totals per ring and per direction; the share is recomputed from the
    sums. `zone` is the ring or direction label."""
    sums = [F.sum("zone_ha").alias("zone_ha"), F.sum("builtup_ha").alias("builtup_ha")]
    rolled = zones.groupingSets(
        [["year", "ring"], ["year", "direction"]], "year", "ring", "direction"
    ).agg(*sums)
    return rolled.select(
        "year", F.when(F.col("ring").isNotNull(), "ring").otherwise("direction").alias("kind"),
        F.coalesce("ring", "direction").alias("zone"), "zone_ha", "builtup_ha",
        F.coalesce(100.0 * F.col("builtup_ha") / F.nullif(F.col("zone_ha"), F.lit(0.0)), F.lit(0.0)).alias("builtup_pct"),
    )


def zone_order(df: DataFrame) -> DataFrame:
    """Report order: year, then lower bound of a band or compass order."""
    names = F.array(*[F.lit(n) for n in cfg.COMPASS])
    lower = F.split_part(F.col("zone"), F.lit("-"), F.lit(1)).try_cast("int")
    rank = F.coalesce(lower, F.array_position(names, F.col("zone")).cast("int"))
    return df.withColumn("ord", rank).orderBy("year", "kind", "ord")


def ring_coverage(zoned: DataFrame, pixel_m2: float, edges=tuple(cfg.RINGS_M)) -> DataFrame:
    """Actual over theoretical ring area: how much the raster cuts off."""
    theory = [math.pi * (hi * hi - lo * lo) for lo, hi in zip(edges, edges[1:])]
    table = F.create_map(*[x for label, a in zip(geo.band_labels(edges), theory) for x in (F.lit(label), F.lit(a))])
    return (
        zoned.where(F.col("ring").isNotNull()).groupBy("ring")
        .agg((F.count(F.lit(1)) * F.lit(float(pixel_m2))).alias("actual_m2"))
        .withColumn("theoretical_m2", F.element_at(table, F.col("ring")))
        .withColumn("coverage", F.col("actual_m2") / F.col("theoretical_m2"))
    )


def ring_share(zoned: DataFrame, area_ha: Column, by=("year",), cls: int = cfg.BUILT_UP) -> DataFrame:
    """Built-up share and hectares per ring from pixel areas."""
    built = F.when(F.col("class") == cls, area_ha).otherwise(0.0)
    return zoned.where(F.col("ring").isNotNull()).groupBy(*by, "ring").agg(
        (100.0 * F.sum(built) / F.sum(area_ha)).alias("builtup_pct"), F.sum(built).alias("builtup_ha")
    )
