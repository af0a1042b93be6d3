import itertools
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.operators import scenes as sc, vectors as ve
from rasterloom.streaming import composites as cs

AFFINE = (10.0, 0.0, 0.0, 0.0, -10.0, 1000.0)


def traversal(x1, y1, x2, y2):
    """Exact cells of a segment, by fractions."""
    u1, u2 = Fraction(x1) / 10, Fraction(x2) / 10
    v1, v2 = (1000 - Fraction(y1)) / 10, (1000 - Fraction(y2)) / 10
    cuts = {Fraction(0), Fraction(1)}
    for p, q in ((u1, u2), (v1, v2)):
        cuts |= {(i - p) / (q - p) for i in range(math.floor(min(p, q)) + 1, math.ceil(max(p, q)))}
    cuts = sorted(cuts)
    at = [0, 1, *((a + b) / 2 for a, b in itertools.pairwise(cuts))]
    return {(math.floor(v1 + (v2 - v1) * t), math.floor(u1 + (u2 - u1) * t)) for t in at}


def test_line_cells_equal_exact_traversal(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(r) for r in (rng.integers(0, 4000, (200, 4)) / 4).tolist()]  # quarter metres: many corners and borders
    rows += [(5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 990.0, 990.0), (0.0, 15.0, 300.0, 15.0), (20.0, 0.0, 20.0, 500.0), (9.99, 0.0, 30.0, 20.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "fid int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in ve.rasterize_lines(df, AFFINE, ["fid"]).collect():
        got.setdefault(r.fid, set()).add((r.row, r.col))
    for i, r in enumerate(rows):
        assert got[i] == traversal(*r), r
    # a corner clipped by a centimetre is no sampling matter
    assert {(99, 0), (99, 1), (98, 1), (98, 2)} <= got[len(rows) - 1]


def observed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(2)) + 2000, int(rng.integers(5)), int(rng.integers(5)), *[None if rng.random() < 0.1 else int(v) for v in rng.integers(0, 10000, 6)], int(rng.integers(4))) for _ in range(n)]
    return spark.createDataFrame(rows, "year int, row int, col int, " + ", ".join(f"{b} int" for b in cfg.BANDS) + ", part int")


def as_rows(df):
    return {(r.year, r.row, r.col): tuple(r[b] for b in [*cfg.BANDS, "n_obs"]) for r in df.collect()}


def test_late_rows_give_the_batch_composite(spark, folder):
    obs = observed(spark).where("NOT (part < 3 AND row = 4)").cache()
    want = as_rows(sc.median_composite(obs))
    schema = obs.drop("part").schema
    for i in range(4):  # every batch has rows of both years and of most pixels
        obs.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        cs.extend_composite(stream, f"{folder}/state").awaitTermination()
    assert as_rows(cs.current_composite(spark, f"{folder}/state")) == want
    # the state goes on after it was made small, and a repeated batch changes nothing
    cs.compact(spark, f"{folder}/state", f"{folder}/small", 3)
    late = obs.where("part = 0 AND row = 0")
    for _ in range(2):
        cs.add_observations(late, f"{folder}/small", 4)
    both = as_rows(sc.median_composite(obs.drop("part").unionAll(late.drop("part"))))
    assert as_rows(cs.current_composite(spark, f"{folder}/small")) == both
    # only touched pixels were finished again
    redone = spark.read.parquet(f"{folder}/small/composite/batch=4")
    assert {r.row for r in redone.select("row").distinct().collect()} == {0}


def test_an_empty_batch_changes_nothing(spark, folder):
    obs = observed(spark, 200, 2).drop("part")
    cs.add_observations(obs, f"{folder}/state", 0)
    cs.add_observations(obs.limit(0), f"{folder}/state", 1)
    assert as_rows(cs.current_composite(spark, f"{folder}/state")) == as_rows(sc.median_composite(obs))
