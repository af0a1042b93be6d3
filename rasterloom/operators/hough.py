"""Straight-line detection: votes, peaks, segments and groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.geo import angular_difference, bearing_rows, hypot
from rasterloom.operators import runs
from rasterloom.session import broadcast_if_small, checkpoint

ANGLES = runs.ANGLES
PEAK_MIN_DISTANCE = 9
PEAK_MIN_ANGLE = 10
BEARING_BIN = 0.05
LENGTH_CLASSES = 8  # for each doubling
RUN_TILE = 256


def theta(index: Column) -> Column:
    """Angle of a grid index: 180 steps over [-90, 90) degrees."""
    return F.radians(index - F.lit(90.0))


def rho(x: Column, y: Column, index: Column) -> Column:
    """Rounded signed distance of a line through (x, y) with that normal."""
    d = x * F.cos(theta(index)) + y * F.sin(theta(index))
    return F.floor(F.round(d, 9) + 0.5).cast("int")


def votes(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accumulator (keys, t, rho, n). Every edge pixel votes once per angle;
    votes are summed map-side, so the shuffle carries accumulator cells, at
    most 180 times twice the raster diagonal per layer and task."""
    cast = edges.select(*keys, "row", "col", F.explode(F.sequence(F.lit(0), F.lit(ANGLES - 1))).alias("t"))
    return cast.groupBy(*keys, "t", rho(F.col("col"), F.col("row"), F.col("t")).alias("rho")).agg(F.count(F.lit(1)).alias("n"))


def peaks(acc: DataFrame, keys: Sequence[str] = (), n: int = cfg.HOUGH_PEAKS) -> DataFrame:
    """Up to n strongest lines per layer. A peak is the largest count of its
    neighbourhood (9 in rho, 10 in angle, angles wrapping at 180 with rho
    mirrored) and above half the layer's maximum. Ties: smaller angle, then
    smaller rho. Then n rounds pick the best and drop its neighbourhood."""
    keys = list(keys)
    layer = keys or ["_layer"]
    acc = acc if keys else acc.withColumn("_layer", F.lit(0))
    # only counts above half the maximum can be peaks or outdo one
    top = broadcast_if_small(acc.groupBy(*layer).agg(F.max("n").alias("_top")))
    strong = checkpoint(acc.join(top, layer).where(F.col("n") > F.col("_top") * 0.5).select(*layer, "t", "rho", "n"))
    # copies of the angles near the wrap, with rho mirrored, so the angular
    # window sees them
    wrap = F.when(F.col("t") < PEAK_MIN_ANGLE, F.array(F.lit(0), F.lit(ANGLES))).when(
        F.col("t") >= ANGLES - PEAK_MIN_ANGLE, F.array(F.lit(0), F.lit(-ANGLES))
    ).otherwise(F.array(F.lit(0)))
    around = strong.withColumn("_s", F.explode(wrap)).select(
        *layer, (F.col("t") + F.col("_s")).alias("t"),
        F.when(F.col("_s") == 0, F.col("rho")).otherwise(-F.col("rho")).alias("rho"), "n",
    )
    reach = F.sequence(F.col("rho") - PEAK_MIN_DISTANCE, F.col("rho") + PEAK_MIN_DISTANCE)
    by_rho = around.select(*layer, "t", F.explode(reach).alias("rho"), "n").groupBy(*layer, "t", "rho").agg(F.max("n").alias("_m"))
    near_t = Window.partitionBy(*layer, "rho").orderBy("t").rangeBetween(-PEAK_MIN_ANGLE, PEAK_MIN_ANGLE)
    highest = by_rho.withColumn("_mm", F.max("_m").over(near_t))
    rest = checkpoint(
        strong.join(highest, [*layer, "t", "rho"]).where(F.col("n") == F.col("_mm")).select(*layer, "t", "rho", "n")
    )
    chosen = None
    for i in range(n):
        best = rest.groupBy(*layer).agg(F.max(F.struct(F.col("n"), (-F.col("t")).alias("_t"), (-F.col("rho")).alias("_r"))).alias("b"))
        best = best.select(*layer, (-F.col("b._t")).alias("t"), (-F.col("b._r")).alias("rho"), F.col("b.n").alias("n"))
        ranked = best.withColumn("peak", F.lit(i + 1))
        chosen = ranked if chosen is None else chosen.unionByName(ranked)
        taken = best.select(*layer, F.col("t").alias("_t"), F.col("rho").alias("_r"))
        dt, dr = F.abs(F.col("t") - F.col("_t")), F.abs(F.col("rho") - F.col("_r"))
        mirrored = F.abs(F.col("rho") + F.col("_r"))
        close = ((dt <= PEAK_MIN_ANGLE) & (dr <= PEAK_MIN_DISTANCE)) | (
            (ANGLES - dt <= PEAK_MIN_ANGLE) & (mirrored <= PEAK_MIN_DISTANCE)
        )
        rest = rest.join(taken, layer).where(~close).select(*layer, "t", "rho", "n")
    bearing = F.pmod(F.degrees(theta(F.col("t"))) + 90.0, F.lit(180.0))
    return chosen.select(*keys, "peak", "t", "rho", "n", bearing.alias("bearing_deg"))


def segments(
    edges: DataFrame, lines: DataFrame, keys: Sequence[str] = (), min_length: float = 150.0,
    gap: float = cfg.LINE_GAP_PX, width: float = 1.0, resolution: float = 10.0,
) -> DataFrame:
    """Straight runs of edge pixels along the given lines: pixels within
    `width` of a line, ordered along it, split where the gap is larger than
    `gap`, kept if at least `min_length` pixels long. The line list is a few
    rows per layer, so edges are not shuffled to meet it; a window holds one
    line, at most a raster diagonal of pixels."""
    keys = list(keys)
    layer = keys or ["_layer"]
    if not keys:
        edges, lines = edges.withColumn("_layer", F.lit(0)), lines.withColumn("_layer", F.lit(0))
    th = theta(F.col("t"))
    few = broadcast_if_small(lines.select(*layer, "peak", "t", F.col("rho").alias("_rho")))
    x, y = F.col("col"), F.col("row")
    near = F.abs(x * F.cos(th) + y * F.sin(th) - F.col("_rho")) <= width
    on = edges.select(*layer, "row", "col").join(few, layer).where(near)
    on = on.withColumn("_p", F.round(y * F.cos(th) - x * F.sin(th), 6))
    w = Window.partitionBy(*layer, "peak").orderBy("_p", "row", "col")
    on = on.withColumn("_new", (F.col("_p") - F.lag("_p").over(w) > gap).cast("int"))
    on = on.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = on.groupBy(*layer, "peak", "_run").agg(
        F.min(F.struct("_p", "row", "col")).alias("a"), F.max(F.struct("_p", "row", "col")).alias("b"), F.count(F.lit(1)).alias("n_px"),
    ).where(F.col("b._p") - F.col("a._p") >= min_length)
    out = ends.select(
        *keys, "peak", F.col("a.row").alias("row1"), F.col("a.col").alias("col1"),
        F.col("b.row").alias("row2"), F.col("b.col").alias("col2"), "n_px",
    )
    return with_bearing_and_length(out, resolution)


def all_segments(
    edges: DataFrame, keys: Sequence[str] = (), min_length: float = 150.0,
    gap: float = cfg.LINE_GAP_PX, width: float = 1.0, resolution: float = 10.0, tile: int = RUN_TILE,
) -> DataFrame:
    """Straight runs of edge pixels along every line, at least `min_length`
    pixels long with gaps of at most `gap`, however many and however weak
    beside the strongest.

    Neighbouring lines find nearly the same run. Each pixel counts for the
    longest run through it (then more pixels, smaller angle, smaller rho), and
    a run stays if at least half of its pixels count for it.

    A tile with its halo follows all lines through its pixels, 180 x (2 x
    width + 1) places for each pixel, without sending any: only pieces of
    runs that go on in another tile are shuffled. They are joined line by
    line, and each tile gets the whole run of its pieces back before its
    pixels choose."""
    layer = list(keys) or ["_layer"]
    edges = edges if keys else edges.withColumn("_layer", F.lit(0))
    pixels = edges.dropna(subset=["row", "col"]).groupBy(*layer, "row", "col").agg(F.count(F.lit(1)).alias("_n"))
    halo = math.floor(math.hypot(gap, 2 * width)) + 1
    def tiles(c):
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    at = [*layer, "_tr", "_tc"]
    # tiles are few and small but costly: not to be coalesced by their bytes
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pixels.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col")).repartition(parts, *at)
    names = dict(edges.select(*layer).dtypes)
    of_tile = ", ".join([*(f"`{k}` {names[k]}" for k in layer), "_tr bigint, _tc bigint"])

    def named(key: tuple, out: pd.DataFrame) -> pd.DataFrame:
        for i, (k, v) in enumerate(zip(at, key)):
            out.insert(i, k, [v] * len(out))
        return out

    def opened(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return named(key, runs.open_pieces(pdf, *key[-2:], tile, gap, width))

    def owned(key: tuple, pdf: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        return named(key, runs.owned_runs(pdf, joined, *key[-2:], tile, gap, width, min_length))

    line = [*layer, "t", "rho"]
    w = Window.partitionBy(*line).orderBy("p1", "r1", "c1")
    pieces = placed.groupBy(*at).applyInPandas(opened, f"{of_tile}, {runs.PIECE}")
    pieces = pieces.withColumn("_new", (F.col("p1") - F.lag("p2").over(w) > gap).cast("int"))
    pieces = pieces.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*line, "_run")
    joined = pieces.select(
        *at, "t", "rho", "r1", "c1", F.min(F.struct("p1", "r1", "c1")).over(run).alias("a"),
        F.max(F.struct("p2", "r2", "c2")).over(run).alias("b"), F.sum("n_px").over(run).alias("_total"),
    ).withColumn("_length", F.round(F.col("b.p2") - F.col("a.p1"), 6)).where(F.col("_length") >= min_length)
    joined = joined.select(
        *at, "t", "rho", "r1", "c1", F.col("a.r1").alias("ra"), F.col("a.c1").alias("ca"),
        F.col("b.r2").alias("rb"), F.col("b.c2").alias("cb"), "_length", "_total",
    )
    counted = placed.groupBy(*at).cogroup(joined.groupBy(*at)).applyInPandas(owned, f"{of_tile}, {runs.OWNED}")
    found = counted.groupBy(*line, "r1", "c1", "r2", "c2", "n_px").agg(F.sum("own").alias("_own"))
    out = found.where(2 * F.col("_own") >= F.col("n_px")).select(
        *keys, "t", "rho", F.col("r1").alias("row1"), F.col("c1").alias("col1"),
        F.col("r2").alias("row2"), F.col("c2").alias("col2"), "n_px",
    )
    return with_bearing_and_length(out, resolution)


def with_bearing_and_length(segs: DataFrame, resolution: float = 10.0) -> DataFrame:
    x1, y1, x2, y2 = F.col("col1"), F.col("row1"), F.col("col2"), F.col("row2")
    return segs.withColumns({
        "bearing_deg": bearing_rows(x1, y1, x2, y2),
        "length_m": hypot((x2 - x1).cast("double"), (y2 - y1).cast("double")) * F.lit(float(resolution)),
    })


def _cell(bearing: Column, length: Column) -> list[Column]:
    """Bin of the bearing and class of the length of a segment."""
    by_length = F.floor(F.round(F.log2(length) * LENGTH_CLASSES, 6)).cast("int")
    return [F.floor(F.round(bearing / BEARING_BIN, 6)).cast("int").alias("_bin"), F.coalesce(by_length, F.lit(-1)).alias("_class")]


def group_segments(segs: DataFrame, keys: Sequence[str] = ("year",), tolerance: float = cfg.ANGLE_TOLERANCE_DEG, mode: str = "linear") -> DataFrame:
    """Assign segments to bearing groups, longest first; a segment joins the
    first group within the tolerance and shifts that group's length-weighted
    bearing. mode 'circular' averages bearings on the half circle, 'linear'
    averages plain degrees.

    The order matters, so one task decides for one layer, but it never sees
    segments: those of one cell, a twentieth of a degree and an eighth of a
    doubling of length, are summed before the shuffle (length, weighted
    bearing and vectors) and go to one group together. A layer has at most
    3600 cells for each class of length, however large the raster. With at
    most one segment in each cell this is the segment-by-segment rule."""
    keys = list(keys)
    length, bearing = F.col("length_m"), F.col("bearing_deg")
    twice = F.radians(2 * bearing)
    placed = segs.select("*", *_cell(bearing, length))
    cells = placed.groupBy(*keys, "_bin", "_class").agg(
        F.round(F.max(length), 6).alias("longest"), F.sum(length).alias("w"), F.sum(bearing * length).alias("wb"),
        F.sum(F.cos(twice) * length).alias("wx"), F.sum(F.sin(twice) * length).alias("wy"), F.min(bearing).alias("least"),
    )

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["longest", "_bin"], ascending=[False, True], kind="stable")
        groups: list[list[float]] = []  # bearing, length sum, weighted sums
        out = []
        for w, wb, wx, wy, least in pdf[["w", "wb", "wx", "wy", "least"]].itertuples(index=False):
            b = wb / w if w > 0 else least
            hit = None
            for g, (gb, *_rest) in enumerate(groups):
                d = abs(b - gb)
                if round(min(d, 180 - d), 9) <= tolerance:
                    hit = g
                    break
            if hit is None:
                groups.append([b, 0.0, 0.0, 0.0, 0.0])
                hit = len(groups) - 1
            g = groups[hit]
            g[1:] = [g[1] + w, g[2] + wb, g[3] + wx, g[4] + wy]
            if g[1] > 0:
                g[0] = math.degrees(math.atan2(g[4], g[3])) / 2 % 180 if mode == "circular" else g[2] / g[1]
            out.append(hit)
        order = sorted(range(len(groups)), key=lambda i: -round(groups[i][1], 6))
        number = {g: i + 1 for i, g in enumerate(order)}
        return pdf[[*keys, "_bin", "_class"]].assign(
            group=[number[g] for g in out], group_bearing_deg=[groups[g][0] for g in out],
            group_total_len_m=[groups[g][1] for g in out],
        )

    schema = cells.select(*keys, "_bin", "_class").withColumns({
        "group": F.lit(0), "group_bearing_deg": F.lit(0.0), "group_total_len_m": F.lit(0.0),
    }).schema
    grouped = cells.groupBy(*keys).applyInPandas(assign, schema)
    return placed.join(grouped, [*keys, "_bin", "_class"]).drop("_bin", "_class")


def hit_rate(segs: DataFrame, classified: DataFrame, keys: Sequence[str] = ("year",), cls: int = cfg.BUILT_UP, step: float = 10.0) -> DataFrame:
    """Share of points along each segment with the class in the 3 x 3 square
    around them. The class map is reduced to pixels of that class, points
    and neighbours are generated, and both meet in an equi-join on the
    pixel. `segs` needs a `seg` id."""
    keys = list(keys)
    n = F.greatest(F.floor(F.col("length_m") / step), F.lit(2)).cast("int")
    f = F.col("_i") / (F.col("_n") - 1)
    def at(a, b):
        return (F.col(a) + (F.col(b) - F.col(a)) * f).cast("int")
    pts = (
        segs.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(*keys, "seg", "_i", at("row1", "row2").alias("_r"), at("col1", "col2").alias("_c"))
    )
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cells = pts.withColumn("_dr", near).withColumn("_dc", near).select(
        *keys, "seg", "_i", (F.col("_r") + F.col("_dr")).alias("row"), (F.col("_c") + F.col("_dc")).alias("col")
    )
    built = classified.where(F.col("class") == cls).select(*keys, "row", "col").distinct()
    found = cells.join(built, [*keys, "row", "col"], "left_semi").groupBy(*keys, "seg").agg(F.countDistinct("_i").alias("_hits"))
    rated = segs.join(found, [*keys, "seg"], "left")
    return rated.withColumn("builtup_pct", F.round(100.0 * F.coalesce("_hits", F.lit(0)) / n, 1)).drop("_hits")


def line_summary(
    grouped: DataFrame, keys: Sequence[str] = ("year",), layers: DataFrame | None = None,
    edges: DataFrame | None = None, peaks: DataFrame | None = None,
) -> DataFrame:
    """Per layer: segment and group counts, the dominant group's bearing,
    total and longest length, its hit rate and the longest segment. `layers`
    lists all layers, so that one without any segment has a row too: counts
    and lengths 0, no bearing. `edges` adds the number of edge pixels, `peaks`
    the bearings of the accumulator's peaks, strongest first."""
    keys = list(keys)
    top = F.col("group") == 1
    length = F.col("length_m")
    rate = F.sum(F.when(top, F.col("builtup_pct") * length)) / F.greatest(F.max(F.when(top, F.col("group_total_len_m"))), F.lit(1e-9))
    out = grouped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.max("group").alias("n_groups"),
        F.round(F.max(F.when(top, F.col("group_bearing_deg"))), 2).alias("dominant_bearing_deg"),
        F.round(F.max(F.when(top, F.col("group_total_len_m"))), 1).alias("dominant_total_len_m"),
        F.round(F.max(F.when(top, length)), 1).alias("dominant_max_len_m"),
        F.count_if(top).alias("dominant_n_segments"),
        F.round(rate, 1).alias("dominant_builtup_pct"), F.round(F.max(length), 1).alias("longest_single_segment_m"),
    )
    if layers is not None:
        zero = [c for c in out.columns if c not in (*keys, "dominant_bearing_deg")]
        out = layers.select(*keys).distinct().join(out, keys, "left").na.fill(0, zero)
    if edges is not None:
        counted = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edge_px"))
        out = out.join(counted, keys, "left").na.fill(0, ["edge_px"])
    if peaks is not None:
        listed = F.array_sort(F.collect_list(F.struct("peak", F.round("bearing_deg", 2).alias("b"))))
        found = peaks.groupBy(*keys).agg(F.transform(listed, lambda p: p["b"]).alias("peak_bearings_deg"))
        out = out.join(found, keys, "left").withColumn("peak_bearings_deg", F.coalesce("peak_bearings_deg", F.array().cast("array<double>")))
    return out


def bearing_gap(summary: DataFrame, axes: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Angle between the dominant line and the main axis of the largest
    component."""
    both = summary.join(axes.select(*keys, F.col("bearing_deg").alias("axis_bearing_deg")), list(keys), "left")
    gap = angular_difference(F.col("dominant_bearing_deg"), F.col("axis_bearing_deg"))
    return both.withColumn("bearing_gap_deg", F.round(gap, 2))
