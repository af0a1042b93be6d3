"""Points against pixels: value extraction and chips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.columns import missing_columns
from rasterloom.functions.geo import pixel_of
from rasterloom.session import broadcast_if_small


def validate_training_points(points: DataFrame) -> DataFrame:
    """x, y and class are required; `label` is accepted for `class`."""
    if "class" not in points.columns and "label" in points.columns:
        points = points.withColumnRenamed("label", "class")
    missing = missing_columns(points, ["x", "y", "class"])
    if missing:
        raise ValueError(f"training points lack {missing}")
    return points


def extract_at_points(pixels: DataFrame, points: DataFrame, affine, bands: Sequence[str]) -> DataFrame:
    """One row per point with the band values of its pixel, NULL outside.
    The pixel table is first reduced to the wanted pixels by an inner join,
    in which Spark may broadcast the points by size; only the reduced rows
    meet the outer join."""
    row, col = pixel_of(F.col("x"), F.col("y"), affine)
    placed = points.withColumns({"row": row, "col": col})
    wanted = placed.select("row", "col").distinct()
    hits = pixels.select("row", "col", *bands).join(wanted, ["row", "col"])
    return placed.join(hits, ["row", "col"], "left")


# Points of one tile that one task serves.
CROWD = 4096


def chips(pixels: DataFrame, points: DataFrame, half: int = 15, tile: int = 64, crowd: int = CROWD) -> DataFrame:
    """All pixels within `half` rows and columns of each point (a square of
    2*half+1), long form. Points go to the up to four tiles their square
    touches; pixels stay where they are when the point list is small enough
    to be broadcast by size, and are shuffled once by tile otherwise.

    A tile with more than `crowd` points is split into portions of about that
    many points, by a hash of the point, and its pixels are repeated for each
    portion (tile^2 rows against `crowd` * (2*half+1)^2 results), so that any
    number of points in one place spreads over the cluster. Points are told
    apart by all their columns; rows that repeat wholly stay in one portion."""
    if 2 * half >= tile:
        raise ValueError("tile must be larger than the chip")
    def tiles(c):
        lo = F.floor((F.col(c) - half) / tile).cast("int")
        hi = F.floor((F.col(c) + half) / tile).cast("int")
        return F.explode(F.array_distinct(F.array(lo, hi)))
    spread = (
        points.select("point_id", F.col("row").alias("prow"), F.col("col").alias("pcol"), "row", "col")
        .withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col")).drop("row", "col")
    )
    placed = pixels.withColumns({
        "_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int"),
    })
    at = ["_tr", "_tc"]
    sizes = spread.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd)
    crowded = broadcast_if_small(sizes.select(*at, F.ceil(F.col("_n") / crowd).cast("int").alias("_portions")))
    portions = F.coalesce("_portions", F.lit(1))
    portion = F.pmod(F.xxhash64("point_id", "prow", "pcol"), portions.cast("bigint")).cast("int")
    spread = spread.join(crowded, at, "left").withColumn("_portion", portion).drop("_portions")
    every = F.explode(F.sequence(F.lit(0), portions - 1))
    placed = placed.join(crowded, at, "left").withColumn("_portion", every).drop("_portions")
    near = (F.abs(F.col("row") - F.col("prow")) <= half) & (F.abs(F.col("col") - F.col("pcol")) <= half)
    return placed.join(spread, [*at, "_portion"]).where(near).drop(*at, "_portion", "prow", "pcol")
