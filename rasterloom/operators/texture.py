"""Grey-level co-occurrence texture on 8 levels, 5 x 5 windows and four
directions, entirely with window sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import focal

LEVELS = 8
RADIUS = 2
PAIRS = 4 * (2 * RADIUS + 1) ** 2


def quantise(nir: Column, levels: int = LEVELS, top: float = 0.5) -> Column:
    """Eight grey levels over [0, top); missing counts as 0."""
    scaled = (F.coalesce(nir, F.lit(0.0)) / F.lit(top) * levels).cast("int")
    return F.least(F.lit(levels - 1), F.greatest(F.lit(0), scaled))


def _pairs(df: DataFrame, level: str, extent, keys, tile, dense) -> DataFrame:
    """Level of each pixel and of its neighbours right, below, lower right
    and upper right; these offsets wrap around the raster."""
    t = focal.halo_tiles(df, [level], extent, 1, "wrap", keys, tile, dense)
    q = F.col(level)
    out = t.df.withColumns({
        "_u": focal.neighbour(q, -1, t.along_cols), "_d": focal.neighbour(q, 1, t.along_cols),
    })
    out = out.withColumns({
        "_j0": focal.neighbour(q, 1, t.along_rows), "_j1": F.col("_d"),
        "_j2": focal.neighbour(F.col("_d"), 1, t.along_rows), "_j3": focal.neighbour(F.col("_u"), 1, t.along_rows),
    })
    # five levels of three bits travel as one integer
    packed = q
    for k in range(4):
        packed = packed + F.col(f"_j{k}") * (1 << (3 * (k + 1)))
    return t.own(out.withColumn("_q", packed.cast("int")), ["_q"])


def glcm(
    df: DataFrame, level: str, extent, keys: Sequence[str] = (), tile: int = focal.TILE, dense: bool = False,
) -> DataFrame:
    """Contrast, entropy (log2), homogeneity and dissimilarity.

    The 64 pair counts of a window are kept in eight longs, one byte each (a
    window has 100 pairs, so a byte never overflows), and two sliding sums
    per long count all pairs. Entropy follows from the counts n as
    log2(100) - sum(n log2 n) / 100."""
    pairs = _pairs(df, level, extent, keys, tile, dense)
    t = focal.halo_tiles(pairs, ["_q"], extent, RADIUS, "reflect", keys, tile, True)

    def bits(k):
        return F.shiftright("_q", 3 * k).bitwiseAND(F.lit(LEVELS - 1))

    i = bits(0)
    js = [bits(k) for k in range(1, 5)]
    def long(c):
        return c.cast("bigint")

    one = long(F.lit(1))
    bytes_ = None
    for j in js:
        term = F.call_function("shiftleft", one, 8 * j)
        bytes_ = term if bytes_ is None else bytes_ + term
    diffs = [F.abs(i - j) for j in js]
    def add(parts):
        return sum(parts[1:], parts[0])
    base = t.df.select(
        *t.id_columns, i.alias("_i"), bytes_.alias("_b"),
        long(add([d * d for d in diffs])).alias("_con"), long(add(diffs)).alias("_dis"),
        add([1.0 / (1.0 + d * d) for d in diffs]).alias("_hom"),
    )
    zero = long(F.lit(0))
    counters = [f"_n{a}" for a in range(LEVELS)]
    sums = [*counters, "_con", "_dis", "_hom"]
    base = base.select(*t.id_columns, *[
        F.when(F.col("_i") == a, F.col("_b")).otherwise(zero).alias(c) for a, c in enumerate(counters)
    ], "_con", "_dis", "_hom")
    across = t.along_rows.rowsBetween(-RADIUS, RADIUS)
    down = t.along_cols.rowsBetween(-RADIUS, RADIUS)
    base = base.select(*t.id_columns, *[F.sum(s).over(across).alias(s) for s in sums])
    base = base.select(*t.id_columns, *[F.sum(s).over(down).alias(s) for s in sums])

    own = t.own(base, sums)
    low = long(F.lit(255))
    counts = F.array(*[
        F.shiftright(c, 8 * b).bitwiseAND(low).cast("double") for c in counters for b in range(LEVELS)
    ])
    # log2(0) is NULL, and such a pair adds nothing
    weight = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + F.coalesce(n * F.log2(n), F.lit(0.0)))
    return own.select(
        *keys, "row", "col",
        (F.col("_con") / PAIRS).alias("glcm_contrast"),
        (F.lit(math.log2(PAIRS)) - weight / PAIRS).alias("glcm_entropy"),
        (F.col("_hom") / PAIRS).alias("glcm_homogeneity"),
        (F.col("_dis") / PAIRS).alias("glcm_dissimilarity"),
    )
