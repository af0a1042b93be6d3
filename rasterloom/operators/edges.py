"""Edge operators on smoothed rasters and the full edge detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.geo import hypot
from rasterloom.operators import focal
from rasterloom.operators.components import connected_components
from rasterloom.operators.quantiles import exact_thresholds
from rasterloom.session import broadcast_if_small, checkpoint

OPERATORS = ["roberts", "prewitt", "sobel", "laplace"]


def _smoothed(df: DataFrame, value: str, valid: str, extent, radius: int, keys, tile, dense, sigma=1.0):
    """Halo tiles with the Gaussian of the raster, invalid cells set to 0."""
    t = focal.halo_tiles(df, [value, valid], extent, radius, "reflect", keys, tile, dense)
    taps = focal.gaussian_taps(sigma)
    ok = F.coalesce(F.col(valid), F.lit(False))
    clean = F.when(ok, F.coalesce(F.col(value).cast("double"), F.lit(0.0))).otherwise(0.0)
    out = t.df.select(*t.id_columns, clean.alias("_x"), (ok & t.in_raster).alias("_ok"))
    return t, out, taps


def _three_by_three(df: DataFrame, t: focal.Tiles, x: str) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """Columns for all nine neighbours of x. Two windows: up and down along
    the column, then left and right of those three along the row."""
    vertical = {-1: f"{x}u", 0: x, 1: f"{x}d"}
    out = df.withColumns({n: focal.neighbour(F.col(x), dy, t.along_cols) for dy, n in vertical.items() if dy})
    named = {(dy, dx): f"{n}{'l' if dx < 0 else 'r'}" for dy, n in vertical.items() for dx in (-1, 1)}
    out = out.withColumns({n: focal.neighbour(F.col(vertical[dy]), dx, t.along_rows) for (dy, dx), n in named.items()})
    cells = {(dy, 0): F.col(n) for dy, n in vertical.items()}
    cells.update({k: F.col(n) for k, n in named.items()})
    return out, cells


def _gradients(m) -> dict[str, tuple[Column, Column]]:
    diag = (m[1, 1] - m[0, 0], m[1, 0] - m[0, 1])
    def pair(k):
        gx = (m[-1, 1] - m[-1, -1]) + k * (m[0, 1] - m[0, -1]) + (m[1, 1] - m[1, -1])
        gy = (m[1, -1] - m[-1, -1]) + k * (m[1, 0] - m[-1, 0]) + (m[1, 1] - m[-1, 1])
        return gx, gy
    return {"roberts": diag, "prewitt": pair(1.0), "sobel": pair(2.0)}


def edge_maps(
    df: DataFrame, value: str, extent, valid: str = "valid", keys: Sequence[str] = (),
    tile: int = focal.TILE, dense: bool = False,
) -> DataFrame:
    """Roberts, Prewitt, Sobel and absolute Laplace of the smoothed raster in
    one exchange: Gaussian and 3 x 3 stencils share the halo."""
    t, out, taps = _smoothed(df, value, valid, extent, 5, keys, tile, dense)
    out = out.withColumn("_h", focal.weighted(F.col("_x"), taps, t.along_rows))
    out = out.withColumn("_s", focal.weighted(F.col("_h"), taps, t.along_cols))
    out, m = _three_by_three(out, t, "_s")
    maps = {name: hypot(gx, gy) for name, (gx, gy) in _gradients(m).items()}
    maps["laplace"] = F.abs(m[-1, 0] + m[1, 0] + m[0, -1] + m[0, 1] - 4.0 * m[0, 0])
    own = t.own(out, [c.alias(n) for n, c in maps.items()])
    return own


def suppressed(
    df: DataFrame, value: str, extent, valid: str = "valid", keys: Sequence[str] = (),
    tile: int = focal.TILE, dense: bool = False, steps: int = cfg.EROSION_STEPS,
) -> DataFrame:
    """(keys, row, col, mag, nms, interior): gradient magnitude and its
    non-maximum suppression along the gradient, bilinear one unit ahead and
    behind, inside the eroded valid area. One exchange with halo 6: smoothing
    4, gradient 1, look-ahead 1; erosion 5 runs on the same tiles."""
    t, out, taps = _smoothed(df, value, valid, extent, max(6, steps), keys, tile, dense)
    out = out.withColumns({
        "_h": focal.weighted(F.col("_x"), taps, t.along_rows),
        "_d": focal.row_clearance(F.col("_ok"), steps, t.along_rows),
    }).drop("_x", "_ok")
    out = out.withColumns({
        "_s": focal.weighted(F.col("_h"), taps, t.along_cols),
        "interior": focal.eroded(F.col("_d"), steps, t.along_cols),
    }).drop("_h", "_d")
    out, m = _three_by_three(out, t, "_s")
    gx, gy = (g / 8.0 for g in _gradients(m)["sobel"])
    out = out.select(*t.id_columns, "interior", gx.alias("_gx"), gy.alias("_gy"))
    out = out.withColumn("mag", hypot(F.col("_gx"), F.col("_gy")))
    # left and right first: the rows are still in row order
    row = {-1: "_ml", 0: "mag", 1: "_mr"}
    out = out.withColumns({n: focal.neighbour(F.col("mag"), dx, t.along_rows) for dx, n in row.items() if dx})
    col = {(dy, dx): f"_m{'u' if dy < 0 else 'd'}{dx + 1}" for dy in (-1, 1) for dx in (-1, 0, 1)}
    out = out.withColumns({n: focal.neighbour(F.col(row[dx]), dy, t.along_cols) for (dy, dx), n in col.items()})
    m = {(0, dx): F.col(n) for dx, n in row.items()} | {k: F.col(n) for k, n in col.items()}
    size = F.greatest(F.col("mag"), F.lit(1e-9))
    ux, uy = F.col("_gx") / size, F.col("_gy") / size
    ax, ay = F.abs(ux), F.abs(uy)

    def ahead(sign):
        right, down = (ux * sign) > 0, (uy * sign) > 0
        def line(dy):
            return (1.0 - ax) * m[dy, 0] + ax * F.when(right, m[dy, 1]).otherwise(m[dy, -1])
        return (1.0 - ay) * line(0) + ay * F.when(down, line(1)).otherwise(line(-1))

    keep = (F.col("mag") > ahead(1)) & (F.col("mag") >= ahead(-1)) & F.col("interior")
    out = out.withColumn("nms", F.when(keep, F.col("mag")).otherwise(0.0))
    return t.own(out, ["mag", "nms", "interior"])


def canny(
    df: DataFrame, value: str, extent, valid: str = "valid", keys: Sequence[str] = (),
    tile: int = focal.TILE, dense: bool = False, min_size: int = cfg.CANNY_MIN_COMPONENT,
) -> tuple[DataFrame, DataFrame]:
    """Edge pixels (keys, row, col) and thresholds (keys, low, high).

    high is the 90th percentile of the positive suppressed magnitudes of a
    layer, low is 0.4 of it. Weak pixels stay if 4-connected to a strong one
    and if the component has at least `min_size` pixels. Only the pixels that
    survive suppression are kept between the passes."""
    keys = list(keys)
    positive = checkpoint(
        suppressed(df, value, extent, valid, keys, tile, dense).where("nms > 0").select(*keys, "row", "col", "nms")
    )
    layer = keys or ["_layer"]
    if not keys:
        positive = positive.withColumn("_layer", F.lit(0))
    limits = exact_thresholds(positive, layer, "nms", cfg.CANNY_PERCENTILE, "high")
    limits = limits.withColumn("low", F.col("high") * cfg.CANNY_LOW_RATIO)
    known = broadcast_if_small(limits)
    weak = positive.join(known, layer).where("nms >= low").select(
        *layer, "row", "col", (F.col("nms") >= F.col("high")).alias("strong")
    )
    labelled = connected_components(weak, extent, layer, carry=["strong"], tile=tile)
    good = (
        labelled.groupBy(*layer, "component")
        .agg(F.count(F.lit(1)).alias("n"), F.max("strong").alias("strong"))
        .where((F.col("n") >= min_size) & F.col("strong"))
        .select(*layer, "component")
    )
    edges = labelled.join(good, [*layer, "component"]).select(*keys, "row", "col")
    return edges, limits.select(*keys, "low", "high")


def edge_flags(df: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edge pixels as a 0/1 column on the full raster."""
    k = [*keys, "row", "col"]
    marked = df.join(edges.select(*k, F.lit(1).alias("edge")), k, "left")
    return marked.withColumn("edge", F.coalesce("edge", F.lit(0)))


def edge_density(flags: DataFrame, extent, keys: Sequence[str] = (), tile: int = focal.TILE, dense: bool = False) -> DataFrame:
    """Share of edge pixels in the 7 x 7 square."""
    return focal.box_mean(flags, "edge", 7, extent, "reflect", keys, tile, dense).withColumnRenamed("edge", "edge_density")


def density_by_class(df: DataFrame, by=("year",), reference: str | None = None) -> DataFrame:
    """Mean edge density and gradient per reference class, NULL for an empty
    class, and the ratio of built-up to bare soil. Aggregated to one row per
    year before the class frame is added."""
    aggs = []
    for c in sorted(cfg.CLASS_NAMES):
        hit = F.col("class") == c
        aggs += [
            F.count_if(hit).alias(f"n{c}"),
            F.avg(F.when(hit, F.col("edge_density"))).alias(f"d{c}"),
            F.avg(F.when(hit, F.col("sobel_gradient"))).alias(f"g{c}"),
        ]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(n).alias("class_name"), F.col(f"n{c}").alias("n_pixels"),
                 F.col(f"d{c}").alias("mean_edge_density"), F.col(f"g{c}").alias("mean_sobel_gradient"))
        for c, n in sorted(cfg.CLASS_NAMES.items())
    ])
    ratio = (F.col("d3") / F.nullif(F.col("d2"), F.lit(0.0))).alias("built_to_bare")
    out = wide.select(*by, ratio, F.explode(rows).alias("r")).select(*by, "r.*", "built_to_bare")
    return out if reference is None else out.withColumn("reference", F.lit(reference))
