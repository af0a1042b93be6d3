"""Steps whose cost must not outgrow their input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import focal, hough as ho, runs, vectors as ve
from test_lines_and_vectors import all_runs


def test_distances_are_never_broadcast(spark):
    """Two sources look small to the planner, their distances to all pixels are not."""
    grid = spark.range(60_000).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    cells = spark.sql("SELECT * FROM VALUES (0, 3), (2999, 15) AS t(row, col)")
    out = ve.nearest_distance(grid, cells, focal.Extent(3000, 20), (1.0, 1.0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = "least(sqrt(pow(row, 2) + pow(col - 3, 2)), sqrt(pow(row - 2999, 2) + pow(col - 15, 2)))"
    assert out.where(F.abs(F.expr(want) - F.col("distance")) < 1e-9).count() == 60_000


@pytest.mark.parametrize("tile", [7, 16])
def test_runs_across_tiles(spark, rng, tile):
    """Runs that cross tiles, along their borders too, repeated pixels and two layers."""
    noise = {(int(a), int(b)) for a, b in rng.integers(0, 40, (130, 2))}
    lines = {(tile, c) for c in range(-5, 45)} | {(r, 2 * tile - 1) for r in range(0, 40, 3)} | {(i, i) for i in range(5, 30)}
    layers = {1: sorted(noise | lines), 2: sorted(lines)}
    rows = [(y, r, c) for y, px in layers.items() for r, c in px] + [(1, None, 3)]
    df = spark.createDataFrame(rows, "year int, row int, col int")
    found = ho.all_segments(df, ["year"], min_length=9, gap=3, tile=tile).collect()
    for y, px in layers.items():
        got = sorted(tuple(r[c] for c in ("t", "rho", "row1", "col1", "row2", "col2")) for r in found if r.year == y)
        assert got == all_runs(px, 9, 3) and got
    twice = ho.all_segments(df.unionAll(df.where("year = 2")).where("year = 2").drop("year"), min_length=9, gap=3, tile=tile)
    # a pixel counts once for its run, and as often as it is there in n_px
    assert {2 * r.n_px for r in found if r.year == 2} > {r.n_px for r in twice.collect()} > set()


def test_pixels_are_not_sent_to_their_lines(spark):
    """Only pieces that go on in another tile leave one."""
    df = spark.range(20_000).where("id % 7 IN (0, 3)").select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    pixels = df.toPandas().assign(_n=1)
    whole = runs.open_pieces(pixels, 0, 0, 256, 3, 1.0)
    half = runs.open_pieces(pixels[pixels["row"] < 104], 0, 0, 100, 3, 1.0)
    assert len(whole) == 0 and 0 < len(half) < 30 * len(pixels)


def test_rectangles_of_many_rings(rng):
    """Rings of a batch together give what each gives alone; degenerate rings do not fail."""
    points = [rng.integers(0, 9, (int(n), 2)).astype(float) for n in rng.integers(3, 21, 400)]
    degenerate = [None, np.zeros((0, 2)), np.ones((4, 2)), np.array([(0.0, 0.0), (3.0, 4.0), (0.0, 0.0)])]
    def boxes(rings):
        xs, ys = (pd.Series([None if r is None else r[:, k] for r in rings], dtype=object) for k in (0, 1))
        return pd.concat(ve._rotated_box(iter([(xs, ys)]))).to_numpy()
    got = boxes(points)
    assert np.allclose(got, np.concatenate([boxes([p]) for p in points]), atol=1e-9)
    for p, (_, length, width) in zip(points, got):
        a = np.radians(np.arange(0, 180, 0.5))
        w, h = np.ptp(p @ [np.cos(a), np.sin(a)], axis=0), np.ptp(p @ [-np.sin(a), np.cos(a)], axis=0)
        assert length * width <= (w * h).min() + 1e-9
    none, empty, one, line = boxes(degenerate)
    assert np.isnan(none).all() and np.isnan(empty).all() and np.isnan(one[0]) and one[1] == one[2] == 0
    assert np.allclose(line[1:], [5, 0], atol=1e-9)
    # one call of numpy serves many rings: a batch of triangles is no loop over them
    calls = []
    hulls = ve._hull
    try:
        ve._hull = lambda pts: calls.append(1) or hulls(pts)
        boxes([rng.random((4, 2)) for _ in range(5000)])
    finally:
        ve._hull = hulls
    assert len(calls) == 0


def test_forest_reads_one_composite(spark):
    from rasterloom.catalog import models

    out = models.rf_predict(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 24
