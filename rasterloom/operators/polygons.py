"""Points, pixels and lines inside polygons, for polygons of any size.

A small polygon is a literal and nothing is shuffled. Beyond that bound a
polygon is an edge table (x1, y1, x2, y2). Edges, points and lines are dealt
into square tiles and meet in equi-joins: lines cross only edges of their own
tiles, and whether a point is inside follows from its tile's corner and the
edges between the two, so no point meets the whole polygon.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.session import checkpoint

EDGE = "x1 double, y1 double, x2 double, y2 double"


def clip_to_polygon(df: DataFrame, rings, affine) -> DataFrame:
    """Pixels whose centre is inside. The polygon's row and column range
    comes first as plain comparisons that reach the Parquet scan."""
    edges = geo.polygon_edges(rings)
    xs, ys = [e[0] for e in edges], [e[1] for e in edges]
    a, _, c, _, e, f = affine
    r0, r1 = math.floor((max(ys) - f) / e), math.ceil((min(ys) - f) / e)
    c0, c1 = math.floor((min(xs) - c) / a), math.ceil((max(xs) - c) / a)
    boxed = df.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    if len(edges) <= geo.MAX_LITERAL_EDGES:
        x, y = geo.pixel_center(F.col("row"), F.col("col"), affine)
        return boxed.where(geo.is_inside(x, y, rings))
    table = df.sparkSession.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    return boxed.join(rasterize_polygon(table, affine), ["row", "col"], "left_semi")


def rasterize_polygon(edges: DataFrame, affine) -> DataFrame:
    """Cells (row, col) whose centre lies inside the polygon given as an edge
    table (x1, y1, x2, y2, optional poly). Scan conversion: every edge is cut
    by the row centre lines it spans, the crossings of a row are paired in
    order, and each pair fills its columns. Work grows with the number of
    crossings and covered cells; no edge meets a pixel it does not bound."""
    a, _, c, _, e, f = (float(v) for v in affine)
    poly = [x for x in ("poly",) if x in edges.columns]
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows whose centre line y = f + (row + .5) * e has lo <= y < hi (e < 0)
    first = F.floor((hi - F.lit(f)) / F.lit(e) - 0.5) + 1
    last = F.floor((lo - F.lit(f)) / F.lit(e) - 0.5)
    cut = edges.where(F.col("y1") != F.col("y2")).withColumns({"_a": first, "_b": last})
    rows = cut.where("_a <= _b").withColumn("row", F.explode(F.sequence(F.col("_a").cast("int"), F.col("_b").cast("int"))))
    y = F.lit(f) + (F.col("row") + 0.5) * F.lit(e)
    at = F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    w = Window.partitionBy(*poly, "row").orderBy("x")
    pairs = (
        rows.select(*poly, "row", at.alias("x"))
        .withColumns({"_i": F.row_number().over(w), "x_next": F.lead("x").over(w)})
        .where((F.col("_i") % 2 == 1) & F.col("x_next").isNotNull())
    )
    # centres c + (col + .5) * a with x <= centre < x_next
    start = F.ceil((F.col("x") - F.lit(c)) / F.lit(a) - 0.5)
    stop = F.ceil((F.col("x_next") - F.lit(c)) / F.lit(a) - 0.5) - 1
    spans = pairs.select(*poly, "row", start.alias("_s"), stop.alias("_e")).where("_s <= _e")
    return spans.select(*poly, "row", F.explode(F.sequence(F.col("_s").cast("int"), F.col("_e").cast("int"))).alias("col"))


def edge_table(polygons: DataFrame, keys: Sequence[str] = (), rings: str = "rings") -> DataFrame:
    """(keys, ring, x1, y1, x2, y2) of polygons whose `rings` are
    array<array<struct<x, y>>>; a ring that is open is closed."""
    ring = polygons.select(*keys, F.posexplode(rings).alias("ring", "_p")).where(F.size("_p") >= 3)
    closed = F.when(F.col("_p")[0] == F.element_at("_p", -1), F.col("_p")).otherwise(F.concat("_p", F.slice("_p", 1, 1)))
    n = F.size("_p") - 1
    ring = ring.withColumn("_p", closed)
    pairs = F.arrays_zip(F.slice("_p", 1, n).alias("p"), F.slice("_p", 2, n).alias("q"))
    edges = ring.select(*keys, "ring", F.explode(pairs).alias("_e"))
    ends = [F.col("_e").getField(k).getField(c).cast("double").alias(f"{c}{i}") for i, k in ((1, "p"), (2, "q")) for c in ("x", "y")]
    return edges.select(*keys, "ring", *ends)


def polygon_area(rings: Column) -> Column:
    """Area of a polygon: its first ring less the others, which are holes."""
    def shoelace(ring):
        n = F.size(ring)
        cross = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2

    sizes = F.transform(rings, shoelace)
    return 2 * F.coalesce(F.try_element_at(sizes, F.lit(1)), F.lit(0.0)) - F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)


def tile_size(edges: DataFrame) -> float:
    """Four mean edges, but not less than a 512th of the polygon's extent."""
    length = geo.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    r = edges.agg(F.avg(length), F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).first()
    return max(4 * (r[0] or 0.0), max(r[1] or 0.0, r[2] or 0.0) / 512) or 1.0


def in_tiles(lines: DataFrame, size: float) -> DataFrame:
    """Each line (x1, y1, x2, y2) once for every tile (tx, ty) that it touches."""
    c, s = F.col, F.lit(float(size))
    margin = 1e-9
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.floor(low / s - margin).cast("long"), F.floor(high / s + margin).cast("long"))
    out = lines.withColumn("ty", F.explode(rows))
    slope = (c("x2") - c("x1")) / F.nullif(c("y2") - c("y1"), F.lit(0.0))
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")

    def at(y, flat):  # a flat line is in the row with all of its length
        return F.when(slope.isNull(), flat).otherwise(F.least(F.greatest(c("x1") + (y - c("y1")) * slope, left), right))

    a, b = at(F.greatest(low, c("ty") * s), left), at(F.least(high, (c("ty") + 1) * s), right)
    columns = F.sequence(F.floor(F.least(a, b) / s - margin).cast("long"), F.floor(F.greatest(a, b) / s + margin).cast("long"))
    return out.withColumn("tx", F.explode(columns))


def with_inside(points: DataFrame, edges: DataFrame, ids: Sequence[str], size: float | None = None) -> DataFrame:
    """`points` (ids, x, y, ...) with `inside`, by the even-odd rule.

    From a point the way goes along its row to the right border of its tile
    and along the border to the tile's upper corner; every edge it crosses
    changes the side. Edges are those of the tile. The corners' sides come
    from the edges that cross the lines between rows of tiles, counted per
    tile and summed from the right."""
    size = size or tile_size(edges)
    c, s, ids = F.col, F.lit(float(size)), list(ids)
    placed = points.withColumns({"tx": F.floor(c("x") / s), "ty": F.floor(c("y") / s)})
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low / s).cast("long"), (F.ceil(high / s) - 1).cast("long")
    cut = edges.where(first <= last).withColumn("_l", F.explode(F.sequence(first, last)))
    x = c("x1") + (c("_l") * s - c("y1")) * ((c("x2") - c("x1")) / (c("y2") - c("y1")))
    counts = cut.select("_l", (F.ceil(x / s) - 1).cast("long").alias("tx")).groupBy("_l", "tx").agg(F.count(F.lit(1)).alias("_n"))
    corners = placed.select((c("ty") + 1).alias("_l"), "tx").distinct()
    line = counts.withColumn("_c", F.lit(False)).unionByName(corners.withColumns({"_n": F.lit(0).cast("long"), "_c": F.lit(True)}))
    right = Window.partitionBy("_l").orderBy(-c("tx")).rangeBetween(Window.unboundedPreceding, -1)
    corners = line.withColumn("_side", F.coalesce(F.sum("_n").over(right), F.lit(0))).where("_c").select((c("_l") - 1).alias("ty"), "tx", "_side")
    near = placed.select(*ids, "x", "y", "tx", "ty").join(in_tiles(edges.select("x1", "y1", "x2", "y2"), size), ["tx", "ty"])
    xr, yt = (c("tx") + 1) * s, (c("ty") + 1) * s
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    xc = c("x1") + (c("y") - c("y1")) * (dx / F.nullif(dy, F.lit(0.0)))
    yc = c("y1") + (xr - c("x1")) * (dy / F.nullif(dx, F.lit(0.0)))
    along = ((c("y1") > c("y")) != (c("y2") > c("y"))) & (c("x") < xc) & (xc <= xr)
    up = ((c("x1") > xr) != (c("x2") > xr)) & (c("y") < yc) & (yc <= yt)
    crossed = near.groupBy(*ids).agg((F.count_if(along) + F.count_if(up)).alias("_k"))
    out = placed.join(corners, ["tx", "ty"]).join(crossed, ids, "left")
    return out.withColumn("inside", (c("_side") + F.coalesce("_k", F.lit(0))) % 2 == 1).drop("tx", "ty", "_side", "_k")


def clip_to_edges(segs: DataFrame, edges: DataFrame, keep: str = "outside", size: float | None = None) -> DataFrame:
    """As `vectors.clip_segments`, for a polygon that is an edge table of any size."""
    size = size or tile_size(edges)
    c = F.col
    rows = checkpoint(segs.withColumn("_sid", F.monotonically_increasing_id()))
    tiles = in_tiles(edges.select("x1", "y1", "x2", "y2"), size).select("tx", "ty", *(c(k).alias(f"e{k}") for k in ("x1", "y1", "x2", "y2")))
    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("ex2") - c("ex1"), c("ey2") - c("ey1")
    den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    t = ((c("ex1") - c("x1")) * ey - (c("ey1") - c("y1")) * ex) / den
    u = ((c("ex1") - c("x1")) * dy - (c("ey1") - c("y1")) * dx) / den
    met = in_tiles(rows.select("_sid", "x1", "y1", "x2", "y2"), size).join(tiles, ["tx", "ty"])
    cuts = met.select("_sid", t.alias("_a"), u.alias("_u")).where("_a > 0 AND _a < 1 AND _u BETWEEN 0 AND 1").select("_sid", "_a")
    ends = rows.select("_sid", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("_a"))
    spans = cuts.unionByName(ends).distinct().withColumn("_b", F.lead("_a").over(Window.partitionBy("_sid").orderBy("_a"))).where("_b IS NOT NULL")
    mid = (c("_a") + c("_b")) / 2
    parts = spans.join(rows, "_sid").withColumns({"x": c("x1") + dx * mid, "y": c("y1") + dy * mid})
    side = with_inside(parts.select("_sid", "_a", "x", "y"), edges, ["_sid", "_a"], size).where("inside" if keep == "inside" else "NOT inside")
    parts = parts.drop("x", "y").join(side.select("_sid", "_a"), ["_sid", "_a"], "left_semi")
    a, b = c("_a"), c("_b")
    moved = {"x1": c("x1") + dx * a, "y1": c("y1") + dy * a, "x2": c("x1") + dx * b, "y2": c("y1") + dy * b, "length_m": geo.hypot(dx, dy) * (b - a)}
    return parts.withColumns(moved).select(*segs.columns, "length_m")
