"""4-neighbour connected components and the shape of a component.

Two levels. Inside a tile, pixels are labelled in one pass; then only labels
that touch a tile border form a graph, which is contracted by joins. The
graph has a few nodes per tile instead of one per pixel, so the iterative
part shrinks by orders of magnitude.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.focal import TILE, Extent
from rasterloom.session import checkpoint

# Rows of a table that need no spreading, and the most keys that get it.
SMALL = 100_000
PARTS = 10_000


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest pixel id reachable inside one tile (at most tile^2 rows)."""
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    slot = np.full((r.max() - r.min() + 2, c.max() - c.min() + 2), -1)
    slot[r - r.min(), c - c.min()] = np.arange(len(r))
    right = np.stack([slot[:, :-1].ravel(), slot[:, 1:].ravel()])
    below = np.stack([slot[:-1].ravel(), slot[1:].ravel()])
    a, b = (e := np.hstack([right, below]))[:, (e >= 0).all(axis=0)]
    order = np.argsort(pdf["id"].to_numpy(), kind="stable")
    rank = np.empty(len(r), dtype=np.int64)
    rank[order] = np.arange(len(r))
    a, b, root = rank[a], rank[b], np.arange(len(r))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    return pdf.assign(component=pdf["id"].to_numpy()[order][root[rank]])


def connected_components(
    pixels: DataFrame, extent: Extent, keys: Sequence[str] = (), carry: Sequence[str] = (), tile: int = TILE,
) -> DataFrame:
    """Label foreground pixels (keys, row, col) with `component`, the
    smallest pixel id row * width + col of the component."""
    keys = list(keys)
    pid = F.col("row").cast("bigint") * extent.cols + F.col("col")
    base = pixels.select(*keys, "row", "col", *carry).withColumns({
        "id": pid, "_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int"),
    })
    schema = base.withColumn("component", F.lit(0).cast("bigint")).schema
    local = base.groupBy(*keys, "_tr", "_tc").applyInPandas(_label_tile, schema)
    local = checkpoint(local.drop("id", "_tr", "_tc"))
    mapping = _merge_labels(_border_edges(local, keys, tile), keys)
    if mapping is None:
        return local
    # one row per label on the right and at most tile^2 pixels per label on
    # the left, so this join has no hot key
    final = local.join(mapping, [*keys, "component"], "left")
    return final.withColumn("component", F.coalesce("root", "component")).drop("root")


def _border_edges(local: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Label pairs (u, v) that touch across a tile border."""
    label = F.col("component")
    row, col = F.col("row"), F.col("col")
    low_r, low_c = row % tile == 0, col % tile == 0
    high_r, high_c = row % tile == tile - 1, col % tile == tile - 1
    pieces = []
    for high, low, dr, dc in ((high_r, low_r, 1, 0), (high_c, low_c, 0, 1)):
        a = local.where(high).select(*keys, (row + dr).alias("row"), (col + dc).alias("col"), label.alias("u"))
        b = local.where(low).select(*keys, "row", "col", label.alias("v"))
        pieces.append(a.join(b, [*keys, "row", "col"]).select(*keys, "u", "v"))
    one_way = pieces[0].unionByName(pieces[1]).distinct()
    return one_way.unionByName(one_way.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _hot_keys(big: DataFrame, on: list[str], total: int) -> DataFrame:
    """Keys with more rows than a ten thousandth of the table and the number
    of parts each is split into: at most PARTS rows, whatever the table."""
    limit = max(SMALL // PARTS, -(-total // PARTS))
    sizes = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return sizes.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))


def _spread_lookup(big: DataFrame, small: DataFrame, on: list[str], spread_by: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join of a table of at most `total` rows, whose keys may be hot,
    to a table with unique keys. A hot key is split into parts by its size
    and only its row of the unique side is repeated; a table that one task
    holds anyway is joined as it is."""
    if total <= SMALL:
        return big.join(small, on, how)
    hot = F.broadcast(_hot_keys(big, on, total))
    part = F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1)).cast("bigint")).cast("int")
    spread = big.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copies = small.join(hot, on, "left").withColumn("_part", every).drop("_parts")
    return spread.join(copies, [*on, "_part"], how).drop("_part")


def _merge_labels(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """Contract the label graph. Every round each node joins its smallest
    neighbour, if smaller than itself, and follows that neighbour's own
    choice; edges are rewritten to the survivors. Rounds are checkpointed and
    the graph at least halves about every round. Returns (component, root)
    of the labels that are not their own root."""
    steps = []
    edges = checkpoint(edges)
    while total := edges.count():
        choice = edges.groupBy(*keys, "u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        onward = choice.select(*keys, F.col("u").alias("p"), F.col("p").alias("root"))
        step = checkpoint(_spread_lookup(choice, onward, [*keys, "p"], "u", total).select(*keys, "u", "root"))
        steps.append(step.where("u <> root"))
        u = _spread_lookup(edges, step, [*keys, "u"], "v", total).select(*keys, F.col("root").alias("_u"), "v")
        second = step.withColumnRenamed("u", "v")
        v = _spread_lookup(u, second, [*keys, "v"], "_u", total).select(*keys, F.col("_u").alias("u"), F.col("root").alias("v"))
        edges = checkpoint(v.where("u <> v").distinct())
    if not steps:
        return None
    return _flat(steps, keys)


def _flat(steps: list[DataFrame], keys: list[str]) -> DataFrame:
    """Roots from the rounds' pointers by pointer doubling. Pointers lead to
    smaller labels of the same component and only its smallest label never
    has one, so each label's smallest pointer is enough."""
    pointers = reduce(DataFrame.unionByName, steps).groupBy(*keys, "u").agg(F.min("root").alias("root"))
    parents = checkpoint(pointers.withColumnRenamed("u", "component"))
    while True:
        # the next pointer of every root, looked up once for each root
        later = parents.select(*keys, F.col("component").alias("root"), F.col("root").alias("_next"))
        onward = checkpoint(parents.select(*keys, "root").distinct().join(later, [*keys, "root"]))
        if onward.isEmpty():
            return parents
        moved = _spread_lookup(parents, onward, [*keys, "root"], "component", parents.count(), "left")
        parents = checkpoint(moved.select(*keys, "component", F.coalesce("_next", "root").alias("root")))


def component_sizes(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))


def component_axes(labelled: DataFrame, keys: Sequence[str] = (), pixel_ha: float = 0.01) -> DataFrame:
    """Size, bearing of the main axis and elongation of every component from
    one aggregate: closed-form eigenvalues of the 2 x 2 covariance of (col,
    -row)."""
    x, y = F.col("col").cast("double"), -F.col("row").cast("double")
    m = labelled.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("px"), F.var_samp(x).alias("_a"), F.covar_samp(x, y).alias("_b"), F.var_samp(y).alias("_c"),
    )
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    half, gap = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    big, small = half + gap, half - gap
    # direction of the main axis: half the angle of (a - c, 2b) from +x
    angle = F.atan2(2 * b, a - c) / 2
    return m.select(
        *keys, "component", "px", (F.col("px") * F.lit(pixel_ha)).alias("ha"),
        F.pmod(90.0 - F.degrees(angle), F.lit(180.0)).alias("bearing_deg"),
        F.sqrt(big / F.greatest(small, F.lit(1e-9))).alias("elongation"),
    )


def largest_component(labelled: DataFrame, keys: Sequence[str] = (), pixel_ha: float = 0.01) -> DataFrame:
    """Axis of the largest component per layer with the number of
    components; ties go to the smallest id. Two aggregates, no sort."""
    keys = list(keys)
    axes = component_axes(labelled, keys, pixel_ha)
    pick = F.max_by(F.struct("component", "px", "ha", "bearing_deg", "elongation"), F.struct("px", -F.col("component")))
    return axes.groupBy(*keys).agg(pick.alias("b"), F.count(F.lit(1)).alias("n_components")).select(*keys, "b.*", "n_components")
