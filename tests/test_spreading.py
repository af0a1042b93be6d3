"""Hot keys: roots of components, crowded tiles, features cut by byte ranges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import components as co, focal, points as pt
from rasters import table


def test_a_hot_key_is_split_by_its_size(spark, monkeypatch):
    """A third of all rows and one more have one key; no part holds twice its share."""
    monkeypatch.setattr(co, "SMALL", 0)
    monkeypatch.setattr(co, "PARTS", 50)
    big = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    hot = {r.k: r._parts for r in co._hot_keys(big, ["k"], 30000).collect()}
    assert hot == {7: 17}
    small = big.select("k").distinct().withColumn("y", F.col("k") * 2)
    got = co._spread_lookup(big, small, ["k"], "x", 30000)
    assert got.count() == 30000 and got.where("y <> 2 * k").count() == 0
    part = F.pmod(F.xxhash64("x"), F.lit(17)).alias("p")
    most = big.where("k = 7").groupBy(part).count().agg(F.max("count")).first()[0]
    assert most < 2 * 10000 / 17
    # keys that the other side lacks survive a left join
    assert co._spread_lookup(big, small.where("k <> 7"), ["k"], "x", 30000, "left").where("y IS NULL").count() == 10001


@pytest.mark.parametrize("small", [0, 100_000])
def test_one_component_winds_through_every_tile(spark, monkeypatch, small):
    """A serpentine crosses many tile borders, so that roots lie many
    pointers away; both forms of the join find its one root."""
    monkeypatch.setattr(co, "SMALL", small)
    monkeypatch.setattr(co, "PARTS", 4)
    size = 12
    on = np.ones((size, size), dtype=int)
    for r in range(1, size, 2):
        on[r] = 0
        on[r, -1 if r % 4 == 1 else 0] = 1
    on[11] = 0
    on[11, 3] = 1
    on[10] = 1
    fg = table(spark, on).where("v = 1").drop("v")
    got = co.connected_components(fg, focal.Extent(size, size), tile=2)
    assert got.count() == on.sum() and {r[0] for r in got.select("component").distinct().collect()} == {0}


def test_pointers_are_doubled_until_flat(spark):
    rounds = [spark.createDataFrame([(i + 1, i)], "u long, root long") for i in range(6, -1, -1)]
    assert {tuple(r) for r in co._flat(rounds, []).select("component", "root").collect()} == {(i, 0) for i in range(1, 8)}


@pytest.mark.parametrize("crowd", [3, 50, 4096])
def test_crowded_points_spread(spark, crowd):
    pixels = table(spark, np.arange(24 * 24).reshape(24, 24))
    pts = spark.range(200).select(
        F.col("id").alias("point_id"), F.when(F.col("id") < 150, 12).otherwise(F.col("id") % 24).cast("int").alias("row"),
        F.when(F.col("id") < 150, 11).otherwise(F.col("id") * 7 % 24).cast("int").alias("col"))
    got = pt.chips(pixels, pts, half=2, tile=8, crowd=crowd).groupBy("point_id").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    want = {}
    for p, r, c in pts.collect():
        cells = [y * 24 + x for y in range(max(r - 2, 0), min(r + 3, 24)) for x in range(max(c - 2, 0), min(c + 3, 24))]
        want[p] = (len(cells), sum(cells))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
