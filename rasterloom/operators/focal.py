"""Neighbourhood operators on halo tiles.

A raster is cut into square tiles and every pixel within `radius` of a tile
edge is copied to the neighbour, so each tile can be worked on alone. One
exchange by tile serves every step of a chain: the windows that run along
rows and along columns partition by (tile, row) and (tile, column), which the
tile exchange already satisfies; only local sorts remain. A tile bounds the
size of every window, however wide the raster is, and the copies cost
(1 + 2 * radius / tile) ** 2.

Steps inside a chain address neighbours by position, so the grid must be
dense. `dense=False` (the default) fills absent pixels with NULL first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rasterloom import config as cfg

TILE = 256


class Extent(NamedTuple):
    rows: int
    cols: int


def raster_extent(df: DataFrame) -> Extent:
    """Raster shape from the pixel table: one row reaches the driver."""
    r, c = df.agg(F.max("row"), F.max("col")).first()
    return Extent((r if r is not None else -1) + 1, (c if c is not None else -1) + 1)


def densify(df: DataFrame, extent: Extent, keys: Sequence[str] = ()) -> DataFrame:
    """Add the absent pixels of every layer with NULL values."""
    spark = df.sparkSession
    rows = F.explode(F.sequence(F.lit(0), F.lit(extent.rows - 1))).alias("row")
    layers = df.select(*keys).distinct() if keys else spark.range(1)
    lines = layers.select(*keys, rows).repartition(*keys, "row")
    frame = lines.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(extent.cols - 1))))
    return frame.join(df, [*keys, "row", "col"], "left")


@dataclass
class Tiles:
    df: DataFrame
    keys: list[str]
    extent: Extent
    tile: int
    along_rows: WindowSpec  # neighbours in the same row
    along_cols: WindowSpec  # neighbours in the same column

    @property
    def id_columns(self) -> list[str]:
        return [*self.keys, "_tr", "_tc", "_r", "_c"]

    @property
    def in_raster(self) -> Column:
        """False on the padding outside the raster."""
        return F.col("_r").between(0, self.extent.rows - 1) & F.col("_c").between(0, self.extent.cols - 1)

    def own(self, df: DataFrame, values: Sequence[str]) -> DataFrame:
        """Drop the halo and the padding; back to (keys, row, col, values)."""
        mine = (F.floor(F.col("_r") / self.tile) == F.col("_tr")) & (F.floor(F.col("_c") / self.tile) == F.col("_tc"))
        return df.where(mine & self.in_raster).select(
            *self.keys, F.col("_r").alias("row"), F.col("_c").alias("col"), *values
        )


def _axis_targets(c: Column, n: int, radius: int, mode: str, tile: int) -> Column:
    """Array of (tile index, padded position) a source index contributes to.
    Most pixels are inside a tile and keep a single entry."""
    last = math.ceil(n / tile) - 1
    shape = "array<struct<t:int,p:int>>"

    def cells(p: Column) -> Column:
        lo = F.greatest(F.lit(0), F.floor((p - radius) / tile)).cast("int")
        hi = F.least(F.lit(last), F.floor((p + radius) / tile)).cast("int")
        a, b = (F.struct(t.alias("t"), p.cast("int").alias("p")) for t in (lo, hi))
        return F.when(lo == hi, F.array(a)).otherwise(F.array(a, b)).cast(shape)

    inner = (c % tile >= radius) & (c % tile < tile - radius) & (c >= radius) & (c < n - radius)
    here = F.array(F.struct(F.floor(c / tile).cast("int").alias("t"), c.cast("int").alias("p"))).cast(shape)
    none = F.array().cast(shape)
    if mode == "constant":
        extra = []
    elif mode == "reflect":
        extra = [(c < radius, cells(-1 - c)), (c >= n - radius, cells(2 * n - 1 - c))]
    elif mode == "wrap":
        extra = [(c < radius, cells(c + n)), (c >= n - radius, cells(c - n))]
    elif mode == "nearest":
        before = F.flatten(F.array(*[cells(F.lit(-k)) for k in range(1, radius + 1)]))
        after = F.flatten(F.array(*[cells(F.lit(n - 1 + k)) for k in range(1, radius + 1)]))
        extra = [(c == 0, before), (c == n - 1, after)]
    else:
        raise ValueError(f"unknown border mode {mode}")
    parts = [cells(c)] + [F.when(hit, arr).otherwise(none) for hit, arr in extra]
    return F.when(inner, here).otherwise(F.concat(*parts))


def halo_tiles(
    df: DataFrame, values: Sequence[str], extent: Extent, radius: int, mode: str = "constant",
    keys: Sequence[str] = (), tile: int = TILE, dense: bool = False,
) -> Tiles:
    """Distribute a raster by tile with a halo; padding outside the raster
    follows the border mode (constant, reflect, nearest, wrap)."""
    if 2 * radius >= tile:
        raise ValueError("the tile must be wider than twice the radius")
    if mode in ("reflect", "wrap") and radius > min(extent):
        raise ValueError("the raster is smaller than the radius")
    keys = list(keys)
    df = df.select(*keys, "row", "col", *values)
    if not dense:
        df = densify(df, extent, keys)
    placed = (
        df.withColumn("_halo_r", F.explode(_axis_targets(F.col("row"), extent.rows, radius, mode, tile)))
        .withColumn("_halo_c", F.explode(_axis_targets(F.col("col"), extent.cols, radius, mode, tile)))
        .select(
            *keys, F.col("_halo_r.t").alias("_tr"), F.col("_halo_c.t").alias("_tc"),
            F.col("_halo_r.p").alias("_r"), F.col("_halo_c.p").alias("_c"), *values,
        )
        .repartition(*keys, "_tr", "_tc")
    )
    one_tile = [*keys, "_tr", "_tc"]
    return Tiles(
        placed, keys, extent, tile,
        Window.partitionBy(*one_tile, "_r").orderBy("_c"),
        Window.partitionBy(*one_tile, "_c").orderBy("_r"),
    )


def neighbour(x: Column, k: int, along: WindowSpec) -> Column:
    """Value k cells further along; NULL beyond the tile's halo or raster."""
    if k == 0:
        return x
    return F.lead(x, k).over(along) if k > 0 else F.lag(x, -k).over(along)


def weighted(x: Column, taps: Sequence[tuple[int, float]], along: WindowSpec) -> Column:
    """Sum of w * neighbour(k); absent neighbours count as 0."""
    total = None
    for k, w in taps:
        term = F.coalesce(neighbour(x, k, along), F.lit(0.0))
        term = term if w == 1 else term * F.lit(float(w))
        total = term if total is None else total + term
    return total


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    raw = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    total = sum(raw.values())
    return [(k, w / total) for k, w in raw.items()]


def convolve(
    df: DataFrame, value: str, taps: Sequence[tuple[int, int, float]], extent: Extent, mode: str = "reflect",
    keys: Sequence[str] = (), tile: int = TILE, dense: bool = False,
) -> DataFrame:
    """Correlate with an arbitrary stencil given as (dy, dx, weight)."""
    radius = max(max(abs(dy), abs(dx)) for dy, dx, _ in taps)
    t = halo_tiles(df, [value], extent, radius, mode, keys, tile, dense)
    lines: dict[int, list[tuple[int, float]]] = {}
    for dy, dx, w in taps:
        lines.setdefault(dy, []).append((dx, w))
    x = F.col(value).cast("double")
    out = t.df.select(*t.id_columns, *[
        weighted(x, row, t.along_rows).alias(f"_h{i}") for i, row in enumerate(lines.values())
    ])
    total = None
    for i, dy in enumerate(lines):
        term = F.coalesce(neighbour(F.col(f"_h{i}"), dy, t.along_cols), F.lit(0.0))
        total = term if total is None else total + term
    return t.own(out.withColumn(value, total), [value])


def box_mean(
    df: DataFrame, value: str, size: int, extent: Extent, mode: str = "reflect",
    keys: Sequence[str] = (), tile: int = TILE, dense: bool = False,
) -> DataFrame:
    """Mean over a size x size square as two sliding sums."""
    r = size // 2
    t = halo_tiles(df, [value], extent, r, mode, keys, tile, dense)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    out = t.df.withColumn("_h", F.sum(x).over(t.along_rows.rowsBetween(-r, r)))
    out = out.withColumn(value, F.sum("_h").over(t.along_cols.rowsBetween(-r, r)) / F.lit(float(size * size)))
    return t.own(out, [value])


def gaussian(
    df: DataFrame, value: str, extent: Extent, sigma: float = 1.0, mode: str = "reflect",
    keys: Sequence[str] = (), tile: int = TILE, dense: bool = False,
) -> DataFrame:
    taps = gaussian_taps(sigma)
    t = halo_tiles(df, [value], extent, max(k for k, _ in taps), mode, keys, tile, dense)
    out = t.df.withColumn("_h", weighted(F.col(value).cast("double"), taps, t.along_rows))
    return t.own(out.withColumn(value, weighted(F.col("_h"), taps, t.along_cols)), [value])


def row_clearance(valid: Column, steps: int, along: WindowSpec) -> Column:
    """Cells to the nearest invalid cell in the row, at most steps + 1."""
    def ok(k):
        both = F.coalesce(neighbour(valid, k, along), F.lit(False)) & F.coalesce(neighbour(valid, -k, along), F.lit(False))
        return both
    expr = F.when(~valid, 0)
    for k in range(1, steps + 1):
        expr = expr.when(~ok(k), k)
    return expr.otherwise(steps + 1)


def eroded(clearance: Column, steps: int, along: WindowSpec) -> Column:
    """True where the 4-neighbour distance to any invalid cell exceeds
    `steps`: the row clearance at vertical offset k must exceed steps - |k|."""
    expr = None
    for k in range(-steps, steps + 1):
        hit = F.coalesce(neighbour(clearance, k, along), F.lit(0)) > steps - abs(k)
        expr = hit if expr is None else expr & hit
    return expr


def erode(
    df: DataFrame, valid: str, extent: Extent, steps: int = cfg.EROSION_STEPS,
    keys: Sequence[str] = (), tile: int = TILE, dense: bool = False,
) -> DataFrame:
    """Repeated 4-neighbour erosion; outside the raster counts as invalid."""
    t = halo_tiles(df, [valid], extent, steps, "constant", keys, tile, dense)
    v = F.coalesce(F.col(valid), F.lit(False))
    out = t.df.withColumn("_v", v).withColumn("_d", row_clearance(F.col("_v"), steps, t.along_rows))
    return t.own(out.withColumn(valid, eroded(F.col("_d"), steps, t.along_cols)), [valid])


def majority(
    df: DataFrame, extent: Extent, label: str = "class", keys: Sequence[str] = (), n_classes: int = 4,
    tile: int = TILE, dense: bool = False,
) -> DataFrame:
    """Most frequent class of the 3 x 3 square; ties go to the smallest
    class; masked cells and cells with a code outside 0..n_classes-1 do not
    vote and have no result. Class counts are packed
    four bits each into one long, so two sliding sums count all classes."""
    if n_classes > 15:
        raise ValueError("at most 15 classes fit the packed counters")
    known = F.when(F.col(label).between(0, n_classes - 1), F.col(label))
    t = halo_tiles(df.withColumn(label, known), [label], extent, 1, "constant", keys, tile, dense)
    votes = F.lit(0).cast("bigint")
    for c in range(n_classes):
        votes = F.when(F.col(label) == c, F.lit(1 << (4 * c)).cast("bigint")).otherwise(votes)
    out = t.df.withColumn("_n", votes)
    out = out.withColumn("_n", F.sum("_n").over(t.along_rows.rowsBetween(-1, 1)))
    out = out.withColumn("_n", F.sum("_n").over(t.along_cols.rowsBetween(-1, 1)))
    def count(c):
        return F.shiftright("_n", 4 * c).bitwiseAND(F.lit(15).cast("bigint"))
    scores = [count(c) * 16 + (15 - c) for c in range(n_classes)]
    best = scores[0] if n_classes == 1 else F.greatest(*scores)
    winner = (F.lit(15) - best % 16).cast("int")
    return t.own(out.where(F.col(label).isNotNull()).withColumn(label, winner), [label])
