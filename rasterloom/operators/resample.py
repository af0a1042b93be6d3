"""Grid resampling: averaging down, interpolating up by whole factors, and
warping between any two grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import geo
from rasterloom.operators import focal


def downsample_mean(df: DataFrame, values: Sequence[str], factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over factor x factor cells, one map-side aggregate."""
    return df.groupBy(
        *keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")
    ).agg(*[F.avg(v).alias(v) for v in values])


def decimated_shape(rows: int, cols: int, max_size: int) -> tuple[int, int]:
    scale = min(1.0, max_size / max(rows, cols))
    return max(1, int(rows * scale)), max(1, int(cols * scale))


def decimate(df: DataFrame, values: Sequence[str], extent: focal.Extent, max_size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Area-weighted average onto a grid whose longer side is at most
    `max_size`. A source pixel meets one or two target cells per axis, in
    proportion to its overlap; shares are summed map-side."""
    h, w = decimated_shape(*extent, max_size)
    def overlaps(c, n, m):
        # source cell [i, i+1) in target units is [i*m/n, (i+1)*m/n)
        lo, hi = F.col(c) * m / n, (F.col(c) + 1) * m / n
        first = F.floor(F.col(c) * m / F.lit(n)).cast("int")
        last = (F.ceil((F.col(c) + 1) * m / F.lit(n)) - 1).cast("int")
        def cell(t):
            part = F.least(hi, t + F.lit(1.0)) - F.greatest(lo, t.cast("double"))
            return F.struct(t.alias("t"), part.alias("w"))
        both = F.array(cell(first), cell(last))
        return F.when(first == last, F.slice(both, 1, 1)).otherwise(both)
    spread = df.withColumn("_r", F.explode(overlaps("row", extent.rows, h))).withColumn("_c", F.explode(overlaps("col", extent.cols, w)))
    weight = F.col("_r.w") * F.col("_c.w")
    sums = [
        (F.sum(F.col(v) * weight) / F.sum(F.when(F.col(v).isNotNull(), weight))).alias(v) for v in values
    ]
    return spread.groupBy(*keys, F.col("_r.t").alias("row"), F.col("_c.t").alias("col")).agg(*sums)


def upsample_nearest(df: DataFrame, factor: int) -> DataFrame:
    """Every coarse cell fills its fine cells; nothing is shuffled."""
    fine = F.sequence(F.lit(0), F.lit(factor - 1))
    out = df.withColumn("_i", F.explode(fine)).withColumn("_j", F.explode(fine))
    return out.withColumns({"row": F.col("row") * factor + F.col("_i"), "col": F.col("col") * factor + F.col("_j")}).drop("_i", "_j")


def _bilinear(t: float) -> float:
    return max(0.0, 1.0 - abs(t))


def _cubic(t: float, a: float = -0.5) -> float:
    """Keys' cubic convolution kernel."""
    t = abs(t)
    if t <= 1:
        return (a + 2) * t**3 - (a + 3) * t**2 + 1
    if t < 2:
        return a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a
    return 0.0


KERNELS = {"bilinear": (_bilinear, 1), "cubic": (_cubic, 2)}


def upsample(
    df: DataFrame, value: str, factor: int, kernel: str, extent: focal.Extent,
    keys: Sequence[str] = (), tile: int = focal.TILE, dense: bool = False,
) -> DataFrame:
    """Separable interpolation to a `factor` times finer grid. Weights are
    normalised over the available source cells, so borders and masked cells
    need no padding. One exchange: both directions run on halo tiles."""
    fn, radius = KERNELS[kernel]
    x = F.col(value).cast("double")
    prepared = df.select(*keys, "row", "col", x.alias("_x"), x.isNotNull().cast("double").alias("_m"))
    tiles = focal.halo_tiles(prepared, ["_x", "_m"], extent, radius, "constant", keys, tile, dense)
    def taps(j):
        center = (j + 0.5) / factor - 0.5
        return [(k, fn(center - k)) for k in range(-radius, radius + 1) if abs(fn(center - k)) > 1e-12]
    x, m = F.coalesce("_x", F.lit(0.0)), F.coalesce("_m", F.lit(0.0))
    df = tiles.df.withColumns({"_x": x, "_m": m})
    sub = range(factor)
    across = {f"{n}{j}": focal.weighted(F.col(n), taps(j), tiles.along_rows) for n in ("_x", "_m") for j in sub}
    df = df.select(*tiles.id_columns, *[c.alias(n) for n, c in across.items()])
    down = {f"{n}_{i}": focal.weighted(F.col(n), taps(i), tiles.along_cols) for n in across for i in sub}
    df = df.select(*tiles.id_columns, *[c.alias(n) for n, c in down.items()])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                 (F.col(f"_x{j}_{i}") / F.nullif(F.col(f"_m{j}_{i}"), F.lit(0.0))).alias("v"))
        for i in range(factor) for j in range(factor)
    ])
    own = tiles.own(df.withColumn("_cells", cells), ["_cells"])
    fine = own.withColumn("_c", F.explode("_cells"))
    return fine.select(
        *keys, (F.col("row") * factor + F.col("_c.i")).alias("row"),
        (F.col("col") * factor + F.col("_c.j")).alias("col"), F.col("_c.v").alias(value),
    )


class Grid(NamedTuple):
    """A raster's place: affine (a, b, c, d, e, f) and its size."""

    affine: tuple[float, ...]
    rows: int
    cols: int


def pixels_of(spark: SparkSession, grid: Grid) -> DataFrame:
    """All pixels (row, col) of a grid."""
    ids = spark.range(grid.rows * grid.cols)
    return ids.select(F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))


def warp(
    df: DataFrame, values: Sequence[str], affine: Sequence[float], target: Grid, method: str = "nearest", keys: Sequence[str] = (),
    to_source: Callable[[Column, Column], tuple[Column, Column]] | None = None, tile: int = 256,
) -> DataFrame:
    """Values of a north-up raster at the pixel centres of another grid.

    Any ratio, any origin; `to_source` takes the target's map coordinates to
    the source's if their projections differ. A target pixel is dealt to the
    source tile that holds its centre, a source pixel to the tiles within the
    kernel's reach, and a tile is one group: two exchanges, no pixel meets
    more than its neighbours. Weights are normalised over the cells that have
    a value. Pixels whose centre lies in no source cell are left out. Kernels
    are not widened for coarser targets; average down first. With `keys`, a
    group holds the tile of all layers, one after the other."""
    radius = 0 if method == "nearest" else KERNELS[method][1]
    values, keys = list(values), list(keys)
    a, _, c0, _, e, f0 = (float(v) for v in affine)
    x, y = geo.pixel_center(F.col("row"), F.col("col"), target.affine)
    if to_source is not None:
        x, y = to_source(x, y)
    places = pixels_of(df.sparkSession, target).withColumns({"_y": (y - F.lit(f0)) / F.lit(e), "_x": (x - F.lit(c0)) / F.lit(a)})
    places = places.withColumns({"_ty": F.floor(F.col("_y") / tile), "_tx": F.floor(F.col("_x") / tile)})

    def reach(c):
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + F.lit(k)) / F.lit(tile)) for k in (-radius, radius)])))

    whole = method == "nearest"
    cells = df.select(*keys, "row", "col", *(F.col(v) if whole else F.col(v).cast("double").alias(v) for v in values))
    cells = cells.withColumn("_ty", reach("row")).withColumn("_tx", reach("col"))
    side = tile + 2 * radius
    kernel = None if whole else np.vectorize(KERNELS[method][0], otypes=[float])

    def at_places(k, source: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        top, left = int(k[0]) * tile - radius, int(k[1]) * tile - radius
        py, px = wanted["_y"].to_numpy(), wanted["_x"].to_numpy()
        own = (np.floor(py).astype(np.int64) - top) * side + np.floor(px).astype(np.int64) - left
        parts = []
        for key, layer in source.groupby(keys, dropna=False, sort=False) if keys else [((), source)]:
            place = (layer["row"].to_numpy() - top) * side + layer["col"].to_numpy() - left
            present = np.zeros(side * side, bool)
            present[place] = True
            there = np.flatnonzero(present[own])
            out = {name: np.repeat(pd.Series([v], dtype=layer[name].dtype).to_numpy(), len(there)) for name, v in zip(keys, key)}
            out |= {"row": wanted["row"].to_numpy()[there], "col": wanted["col"].to_numpy()[there]}
            for v in values:
                if whole:
                    slot = np.full(side * side, -1)
                    slot[place] = np.arange(len(place))
                    out[v] = layer[v].to_numpy()[slot[own[there]]]
                    continue
                dense = np.full(side * side, np.nan)
                dense[place] = layer[v].to_numpy(dtype=float)
                out[v] = _interpolated(dense, side, py[there] - top, px[there] - left, kernel, radius)
            parts.append(pd.DataFrame(out))
        return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in names})

    kinds = {x.name: x.dataType for x in cells.schema}
    names = [*keys, "row", "col", *values]
    kinds |= {"row": T.IntegerType(), "col": T.IntegerType()}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    return cells.groupBy("_ty", "_tx").cogroup(places.groupBy("_ty", "_tx")).applyInPandas(at_places, schema)


def _interpolated(dense: np.ndarray, side: int, y: np.ndarray, x: np.ndarray, kernel, radius: int) -> np.ndarray:
    """Separable kernel at fractional places of a dense tile, over the cells that have a value."""
    total, weight = np.zeros(len(y)), np.zeros(len(y))
    fy, fx = np.floor(y - 0.5).astype(np.int64), np.floor(x - 0.5).astype(np.int64)
    for dy in range(1 - radius, radius + 1):
        wy = kernel(y - 0.5 - fy - dy) if len(y) else y
        for dx in range(1 - radius, radius + 1):
            w = wy * (kernel(x - 0.5 - fx - dx) if len(x) else x)
            v = dense[(fy + dy) * side + fx + dx]
            some = ~np.isnan(v)
            total[some] += w[some] * v[some]
            weight[some] += w[some]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.abs(weight) > 1e-9, total / weight, np.nan)
