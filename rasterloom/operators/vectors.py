"""Line and polygon features: filters, clipping, lengths, areas, rasterising
and the distance to the nearest feature."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import config as cfg
from rasterloom.functions import geo
from rasterloom.operators.focal import Extent
from rasterloom.operators.polygons import EDGE, clip_to_edges, polygon_area
from rasterloom.session import checkpoint


def filter_features(
    features: DataFrame, bounds: tuple[float, float, float, float] | None = None,
    highway: Sequence[str] | None = None, name_pattern: str | None = None, equals: dict[str, str] | None = None,
) -> DataFrame:
    """Envelope and attribute filters. The envelope columns are plain
    doubles, so the box reaches the scan; names match without case and a
    missing name counts as empty."""
    out = features
    if bounds is not None:
        xmin, ymin, xmax, ymax = bounds
        out = out.where(
            (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
        )
    if highway is not None:
        out = out.where(F.col("highway").isin(*highway))
    for column, value in (equals or {}).items():
        out = out.where(F.col(column) == value)
    if name_pattern is not None:
        out = out.where(F.coalesce("name", F.lit("")).rlike(f"(?i){name_pattern}"))
    return out


def exactly_one(features: DataFrame) -> DataFrame:
    """Raise unless there is exactly one feature (two rows read at most)."""
    if len(features.take(2)) != 1:
        raise ValueError("expected exactly one feature")
    return features


def with_envelope(segs: DataFrame) -> DataFrame:
    return segs.withColumns({
        "xmin": F.least("x1", "x2"), "xmax": F.greatest("x1", "x2"),
        "ymin": F.least("y1", "y2"), "ymax": F.greatest("y1", "y2"),
    })


def line_segments(features: DataFrame, coords: str = "coords") -> DataFrame:
    """Explode coordinate arrays into consecutive segments."""
    pairs = F.arrays_zip(
        F.slice(coords, 1, F.size(coords) - 1).alias("p"), F.slice(coords, 2, F.size(coords) - 1).alias("q")
    )
    rest = [c for c in features.columns if c != coords]
    s = features.where(F.size(coords) >= 2).select(*rest, F.posexplode(pairs).alias("seg", "s"))
    p, q = F.col("s").getField("p"), F.col("s").getField("q")
    return s.select(
        *rest, "seg", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
    )


def project_segments(segs: DataFrame, zone: int = cfg.UTM_ZONE) -> DataFrame:
    x1, y1 = geo.lonlat_to_utm(F.col("x1"), F.col("y1"), zone)
    x2, y2 = geo.lonlat_to_utm(F.col("x2"), F.col("y2"), zone)
    return segs.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def segment_length(df: DataFrame | None = None) -> Column:
    return geo.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def ring_area(coords: Column) -> Column:
    """Shoelace area of a closed ring given as array<struct<x,y>>."""
    n = F.size(coords)
    cross = F.zip_with(
        F.slice(coords, 1, n - 1), F.slice(coords, 2, n - 1),
        lambda p, q: p["x"] * q["y"] - q["x"] * p["y"],
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def clip_segments(segs: DataFrame, rings, keep: str = "outside") -> DataFrame:
    """Parts of segments inside or outside a polygon (holes honoured), one
    row per part with its length. Each segment is cut where it crosses an
    edge; the midpoint of each part decides its side. `rings` are lists of
    points or an edge table. A polygon within the bound of literals shuffles
    nothing; any other meets the segments tile by tile (clip_to_edges)."""
    if isinstance(rings, DataFrame):
        return clip_to_edges(segs, rings, keep)
    if len(listed := geo.polygon_edges(rings)) > geo.MAX_LITERAL_EDGES:
        return clip_to_edges(segs, segs.sparkSession.createDataFrame(listed, EDGE), keep)
    edges = geo.literal_edges(rings)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1

    def crossing(e):
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
        t = ((e["x1"] - x1) * ey - (e["y1"] - y1) * ex) / den
        u = ((e["x1"] - x1) * dy - (e["y1"] - y1) * dx) / den
        return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    cuts = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(edges, crossing))
    )))
    cut = segs.withColumn("_t", cuts)
    n = F.size("_t")
    spans = F.arrays_zip(F.slice("_t", 1, n - 1).alias("a"), F.slice("_t", 2, n - 1).alias("b"))
    parts = cut.withColumn("_s", F.explode(spans)).drop("_t")
    a, b = F.col("_s.a"), F.col("_s.b")
    mid = (a + b) / 2
    inside = geo.is_inside(x1 + dx * mid, y1 + dy * mid, rings)
    parts = parts.where(inside if keep == "inside" else ~inside)
    return parts.withColumns({
        "x1": x1 + dx * a, "y1": y1 + dy * a, "x2": x1 + dx * b, "y2": y1 + dy * b,
        "length_m": geo.hypot(dx, dy) * (b - a),
    }).drop("_s")


def clip_features(segs: DataFrame, vicinity, fence, ids: Sequence[str] = ("fid",), min_length: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Segments inside the vicinity and outside the fence, features shorter
    than `min_length` dropped; and the removed length per feature."""
    near = checkpoint(clip_segments(segs, vicinity, "inside").drop("length_m"))
    outside = checkpoint(clip_segments(near, fence, "outside"))
    removed = clip_segments(near, fence, "inside").groupBy(*ids).agg(F.sum("length_m").alias("removed_m"))
    long = outside.groupBy(*ids).agg(F.sum("length_m").alias("_total")).where(F.col("_total") >= min_length)
    return outside.join(long.select(*ids), list(ids), "left_semi"), removed


def length_inside(segs: DataFrame, rings) -> DataFrame:
    return clip_segments(segs, rings, "inside").agg(F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("inside_m"))


def near_box(x: Column, y: Column, box: tuple[float, float, float, float], distance: float) -> Column:
    """Within `distance` of a box: its buffer as a predicate."""
    xmin, ymin, xmax, ymax = box
    gx = F.greatest(F.lit(xmin) - x, x - F.lit(xmax), F.lit(0.0))
    gy = F.greatest(F.lit(ymin) - y, y - F.lit(ymax), F.lit(0.0))
    return geo.hypot(gx, gy) <= distance


def feature_totals(segs: DataFrame, rings=None, polygons: DataFrame | None = None) -> DataFrame:
    """Feature count, total length, length inside a polygon and the sorted
    distinct names of a feature set. Names come from a bounded dimension.
    `polygons` (with `rings`) adds the sum of their areas without holes."""
    totals = segs.agg(F.countDistinct("fid").alias("n_features"), F.sum(segment_length()).alias("total_length_m"))
    names = segs.select(feature_name().alias("name")).distinct().agg(F.array_sort(F.collect_list("name")).alias("names"))
    out = totals.withColumn("_k", F.lit(1)).join(names.withColumn("_k", F.lit(1)), "_k")
    if rings is not None:
        out = out.join(length_inside(segs, rings).withColumn("_k", F.lit(1)), "_k")
    if polygons is not None:
        area = polygons.agg(F.coalesce(F.sum(polygon_area(F.col("rings"))), F.lit(0.0)).alias("polygon_area_m2"))
        out = out.join(area.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def feature_name(unnamed: str = "(unnamed)", ref: Column | None = None) -> Column:
    name = F.nullif(F.col("name"), F.lit(""))
    fallback = F.lit(unnamed) if ref is None else F.coalesce(F.nullif(ref, F.lit("")), F.lit(unnamed))
    return F.coalesce(name, fallback)


def rasterize_lines(segs: DataFrame, affine, ids: Sequence[str] = ()) -> DataFrame:
    """Cells that line segments run through, and the cells of both ends.

    The crossings with the lines between rows and columns cut a segment into
    pieces, and each piece lies in one cell, that of its middle; a corner
    clipped ever so little counts. Pieces under a billionth of the segment
    are crossings of one corner and no cells. A segment along a border
    belongs to the cells on the border's larger side. One narrow pass; a row
    carries the crossings of its own segment only."""
    a, _, c, _, e, f = (float(v) for v in affine)
    u, v = [((F.col(k) - c) / a).alias(f"_u{k[1]}") for k in ("x1", "x2")], [((F.col(k) - f) / e).alias(f"_v{k[1]}") for k in ("y1", "y2")]
    cut = segs.select(*ids, *u, *v)

    def crossings(p, q):
        low, high = F.floor(F.least(p, q)) + 1, F.ceil(F.greatest(p, q)) - 1
        whole = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(whole, lambda i: (i - F.col(p)) / (F.col(q) - F.col(p)))

    at = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("_u1", "_u2"), crossings("_v1", "_v2")))
    cut = cut.withColumn("_t", at)
    size = F.size("_t")
    pairs = F.arrays_zip(F.slice("_t", 1, size - 1).alias("a"), F.slice("_t", 2, size - 1).alias("b"))
    middles = F.transform(F.filter(pairs, lambda p: p["b"] - p["a"] > 1e-9), lambda p: (p["a"] + p["b"]) / 2)
    cut = cut.withColumn("_m", F.explode(F.concat(F.array(F.lit(0.0), F.lit(1.0)), middles)))
    def cell(p, q):
        return F.floor(F.col(p) + (F.col(q) - F.col(p)) * F.col("_m")).cast("int")
    return cut.select(*ids, cell("_v1", "_v2").alias("row"), cell("_u1", "_u2").alias("col")).distinct()


def nearest_distance(
    grid: DataFrame, sources: DataFrame, extent: Extent, spacing: tuple[float, float] = (10.0, 10.0),
    strip: int = 32,
) -> DataFrame:
    """Exact distance from every pixel centre to the nearest source pixel.

    Two separable passes. Pass one finds, in every column that has sources
    (inside the raster or out), the source row nearest to each raster row with
    running windows, one window per column. Pass two takes, along each row, the minimum of
    (dx^2 + g^2) over columns; rows are independent, so strips of rows are
    worked on in parallel. Very wide rasters use strip=1; one row always
    fits a task. The distances are as many as the pixels, however few the
    sources from which the planner estimates their size, so both sides of the
    last join are sorted and none is broadcast. Without any source the
    distance is NULL."""
    sy, sx = spacing
    places = sources.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    cells = places.select("col").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(extent.rows - 1))).alias("row"), "col")
    marked = cells.withColumn("_src", F.lit(None).cast("int")).unionByName(places.withColumn("_src", F.col("row")))
    # a cell and a source of the same row are peers and see each other
    down = Window.partitionBy("col").orderBy("row").rangeBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("col").orderBy(F.desc("row")).rangeBetween(Window.unboundedPreceding, 0)
    above = F.last("_src", ignorenulls=True).over(down)
    below = F.last("_src", ignorenulls=True).over(up)
    gap = F.least(F.col("row") - above, below - F.col("row")) * F.lit(float(sy))
    g = marked.select("row", "col", "_src", gap.alias("g"))
    g = g.where(F.col("_src").isNull())
    strips = g.groupBy(F.floor(F.col("row") / strip).alias("_strip"))
    xs = np.arange(extent.cols) * float(sx)

    def envelope(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row, line in pdf.dropna(subset=["g"]).groupby("row"):
            line = line.sort_values("col")
            best = _row_minimum(line["col"].to_numpy() * float(sx), line["g"].to_numpy() ** 2, xs)
            parts.append(pd.DataFrame({
                "row": np.int32(row), "col": np.arange(len(xs), dtype=np.int32), "distance": np.sqrt(best),
            }))
        return pd.concat(parts) if parts else pd.DataFrame({"row": [], "col": [], "distance": []})

    near = strips.applyInPandas(envelope, "row int, col int, distance double")
    return grid.join(near.hint("merge"), ["row", "col"], "left")


def _row_minimum(src: np.ndarray, base: np.ndarray, out: np.ndarray) -> np.ndarray:
    """min over j of (out[i] - src[j])^2 + base[j]. The best j never moves
    left as out grows, so positions are solved from coarse to fine, each
    within the range its solved neighbours leave: n log n, exact."""
    n = len(out)
    pick = np.zeros(n + 2, dtype=np.int64)
    pick[n + 1] = len(src) - 1
    best = np.empty(n)
    step = 1 << max(n - 1, 0).bit_length()
    while step:
        at = np.arange(step, n + 1, 2 * step)
        if len(at):
            lo, hi = pick[at - step], pick[np.minimum(at + step, n + 1)]
            size = hi - lo + 1
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            j = np.arange(size.sum()) + np.repeat(lo - start, size)
            cost = (np.repeat(out[at - 1], size) - src[j]) ** 2 + base[j]
            low = np.minimum.reduceat(cost, start)
            first = np.flatnonzero(cost == np.repeat(low, size))
            pick[at] = j[first[np.searchsorted(first, start)]]
            best[at - 1] = low
        step //= 2
    return best


AXIS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("bearing_deg", "length", "width")])


def _rotated_box(rings: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Smallest rotated rectangle of each ring: one side lies on an edge of
    the convex hull. Rings of about the same number of points are worked on
    together. A ring without points gives NULL, one of a single point the
    lengths 0 and no bearing."""
    for xs, ys in rings:
        out = np.full((len(xs), 3), np.nan)
        size = np.array([0 if x is None else len(x) for x in xs], dtype=np.int64)
        wide = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for n in np.unique(wide[size > 0]):
            of_class = np.flatnonzero((wide == n) & (size > 0))
            for part in np.array_split(of_class, -(-len(of_class) * n // (1 << 18))):
                x, y = _padded(xs, size, part, n), _padded(ys, size, part, n)
                if len(part) < 8:
                    hulls = [_hull(np.unique(np.column_stack([p, q]), axis=0)) for p, q in zip(x, y)]
                    count = np.array([len(h) for h in hulls])
                    hull = np.zeros((len(part), max(count.max(), 1), 2))
                    for i, h in enumerate(hulls):
                        if len(h):
                            hull[i] = h[np.minimum(np.arange(hull.shape[1]), len(h) - 1)]
                else:
                    hull, count = _hulls(x, y)
                step = max((1 << 21) // hull.shape[1] ** 2, 1)
                for i in range(0, len(part), step):
                    out[part[i:i + step]] = _boxes(hull[i:i + step], count[i:i + step])
        yield pd.DataFrame(out, columns=["bearing_deg", "length", "width"])


def _padded(values: pd.Series, size: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """One row for each ring; its last point repeats, which moves no hull."""
    flat = np.concatenate([values.iloc[i] for i in part])
    start = np.cumsum(size[part]) - size[part]
    return flat[start[:, None] + np.minimum(np.arange(n), size[part, None] - 1)]


def _boxes(hull: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bearing, length and width for hulls (ring, point, x and y) of which the
    first `count` points count and the others repeat one of them."""
    each, m = np.arange(hull.shape[0])[:, None], np.arange(hull.shape[1])
    edge = hull[each, np.where(m + 1 < count[:, None], m + 1, 0)] - hull
    real = (m < count[:, None]) & (edge != 0).any(axis=2)
    u = edge / np.where(real, np.hypot(edge[..., 0], edge[..., 1]), 1.0)[..., None]
    x, y, ux, uy = hull[:, None, :, 0], hull[:, None, :, 1], u[..., 0, None], u[..., 1, None]
    w, h = np.ptp(x * ux + y * uy, axis=2), np.ptp(y * ux - x * uy, axis=2)
    k = np.argmin(np.where(real, np.round(w * h, 6), np.inf), axis=1)
    at = each[:, 0], k
    w, h, u, some = w[at], h[at], u[at], real.any(axis=1)
    turned = np.round(w, 9) < np.round(h, 9)  # a square keeps the direction of its edge
    bx, by = np.where(turned, -u[:, 1], u[:, 0]), np.where(turned, u[:, 0], u[:, 1])
    bearing = np.where(some, np.degrees(np.arctan2(bx, by)) % 180.0, np.nan)
    return np.column_stack([bearing, np.where(some, np.maximum(w, h), 0.0), np.where(some, np.minimum(w, h), 0.0)])


def _hulls(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _hull for many rings of equally many points, point by point for all
    of them at once. Returns the hulls, padded with their first points, and
    the numbers of their points."""
    order = np.lexsort((y, x), axis=1)
    x, y = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
    fresh = np.ones(x.shape, dtype=bool)
    fresh[:, 1:] = (x[:, 1:] != x[:, :-1]) | (y[:, 1:] != y[:, :-1])
    rings, n = x.shape

    def chain(points):
        stack, top = np.zeros((rings, n), dtype=np.int64), np.zeros(rings, dtype=np.int64)
        for i in points:
            turn = np.flatnonzero(fresh[:, i] & (top >= 2))
            while len(turn):
                p, q = stack[turn, top[turn] - 2], stack[turn, top[turn] - 1]
                x0, y0 = x[turn, p], y[turn, p]
                left = (x[turn, q] - x0) * (y[turn, i] - y0) - (y[turn, q] - y0) * (x[turn, i] - x0)
                turn = turn[left <= 0]
                top[turn] -= 1
                turn = turn[top[turn] >= 2]
            new = np.flatnonzero(fresh[:, i])
            stack[new, top[new]] = i
            top[new] += 1
        return stack, top - 1

    (lower, n_low), (upper, n_up) = chain(range(n)), chain(range(n - 1, -1, -1))
    count = n_low + n_up
    m = np.arange(max(count.max(), 1))
    each = np.arange(rings)[:, None]
    from_upper = np.clip(m - n_low[:, None], 0, n - 1)
    at = np.where(m < n_low[:, None], lower[each, np.minimum(m, n - 1)], upper[each, from_upper])
    at = np.where(m < count[:, None], at, lower[:, :1])
    return np.stack([x[each, at], y[each, at]], axis=2), count


def _hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull of sorted unique points, counter-clockwise."""
    def chain(points):
        out: list = []
        for p in points:
            while len(out) >= 2 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out
    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def principal_axis(polygons: DataFrame, coords: str = "coords") -> DataFrame:
    """Bearing and length of the long side of the minimum rotated rectangle
    of each polygon (one row = one polygon)."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    rest = [c for c in polygons.columns if c != coords]
    box = F.pandas_udf(_rotated_box, AXIS)
    return polygons.select(*rest, box(xs, ys).alias("b")).select(*rest, "b.*")
