"""Stencils, texture, edges, components and distances against numpy."""

import math
from collections import Counter, deque

import numpy as np
import pytest
from rasters import array, table
from pyspark.sql import functions as F

from rasterloom.operators import components as co, edges as ed, focal, resample as rs, texture as tx, vectors as ve

SHAPE = (23, 31)
E = focal.Extent(*SHAPE)


def correlate(x, taps, mode="symmetric"):
    r = max(max(abs(a), abs(b)) for a, b, _ in taps)
    p = np.pad(x, r, mode=mode) if mode != "constant" else np.pad(x, r)
    h, w = x.shape
    return sum(k * p[r + dy:r + dy + h, r + dx:r + dx + w] for dy, dx, k in taps)


@pytest.mark.parametrize("mode, pad", [("reflect", "symmetric"), ("nearest", "edge"), ("wrap", "wrap"), ("constant", "constant")])
def test_border_modes(spark, rng, mode, pad):
    x = rng.integers(0, 100, SHAPE).astype(float)
    taps = [(dy, dx, float(3 * dy + dx + 5)) for dy in (-2, 0, 1) for dx in (-1, 0, 2)]
    got = array(focal.convolve(table(spark, x), "v", taps, E, mode, tile=8), "v", SHAPE)
    np.testing.assert_allclose(got, correlate(x, taps, pad))


def test_sparse_input_is_filled(spark, rng):
    x = rng.integers(0, 100, SHAPE).astype(float)
    df = table(spark, x).where("(row + col) % 3 <> 0")
    mask = (np.indices(SHAPE).sum(axis=0) % 3 != 0)
    got = array(focal.box_mean(df, "v", 3, E, tile=8), "v", SHAPE)
    taps = [(a, b, 1 / 9) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    np.testing.assert_allclose(got, correlate(np.where(mask, x, 0), taps))


def test_majority(spark, rng):
    x = rng.integers(0, 4, SHAPE)
    got = array(focal.majority(table(spark, x, "class"), E, tile=8), "class", SHAPE)
    for r in range(SHAPE[0]):
        for c in range(SHAPE[1]):
            n = Counter(x[max(0, r - 1):r + 2, max(0, c - 1):c + 2].ravel().tolist())
            assert got[r, c] == min(n, key=lambda k: (-n[k], k))


def test_layers_do_not_mix(spark, rng):
    a, b = rng.random(SHAPE), rng.random(SHAPE)
    df = table(spark, a).withColumn("year", F.lit(1)).union(table(spark, b).withColumn("year", F.lit(2)))
    both = focal.gaussian(df, "v", E, keys=["year"], tile=16)
    taps = [(i, j, p * q) for i, p in focal.gaussian_taps(1.0) for j, q in focal.gaussian_taps(1.0)]
    for year, x in ((1, a), (2, b)):
        np.testing.assert_allclose(array(both.where(F.col("year") == year), "v", SHAPE), correlate(x, taps))


def test_erosion(spark, rng):
    ok = rng.random(SHAPE) > 0.004
    got = array(focal.erode(table(spark, ok, "valid"), "valid", E, 5, tile=12), "valid", SHAPE).astype(bool)
    want = ok.copy()
    for _ in range(5):
        p = np.pad(want, 1)
        want = want & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    assert (got == want).all() and want.any()


def test_glcm(spark, rng):
    """Count the level pairs of every 5 x 5 window one by one."""
    h, w = SHAPE
    levels = rng.integers(0, 8, SHAPE)
    result = tx.glcm(table(spark, levels, "q"), "q", E, tile=16)
    got = {n: array(result, f"glcm_{n}", SHAPE) for n in ("contrast", "entropy", "homogeneity", "dissimilarity")}
    # windows whose pixels and their partners lie inside the raster
    for r in range(4, h - 4, 3):
        for c in range(4, w - 4, 3):
            pairs = Counter(
                (levels[y, x], levels[y + dy, x + dx])
                for y in range(r - 2, r + 3) for x in range(c - 2, c + 3) for dy, dx in ((0, 1), (1, 0), (1, 1), (-1, 1)))
            share = {k: n / 100 for k, n in pairs.items()}
            gap = {k: abs(int(k[0]) - int(k[1])) for k in share}
            assert got["contrast"][r, c] == pytest.approx(sum(p * gap[k] ** 2 for k, p in share.items()))
            assert got["dissimilarity"][r, c] == pytest.approx(sum(p * gap[k] for k, p in share.items()))
            assert got["homogeneity"][r, c] == pytest.approx(sum(p / (1 + gap[k] ** 2) for k, p in share.items()))
            assert got["entropy"][r, c] == pytest.approx(-sum(p * np.log2(p) for p in share.values()))


def bfs_labels(mask):
    lab, h, w = {}, *mask.shape
    for r in range(h):
        for c in range(w):
            if mask[r, c] and (r, c) not in lab:
                todo = deque([(r, c)])
                lab[r, c] = r * w + c
                while todo:
                    a, b = todo.popleft()
                    for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= n[0] < h and 0 <= n[1] < w and mask[n] and n not in lab:
                            lab[n] = r * w + c
                            todo.append(n)
    return lab


@pytest.mark.parametrize("kind", ["random", "snake", "full", "comb"])
def test_components_across_tiles(spark, rng, kind):
    mask = rng.random(SHAPE) < 0.6
    if kind == "snake":
        mask = np.zeros(SHAPE, bool)
        mask[::2] = True
        mask[1::4, -1] = mask[3::4, 0] = True
    elif kind == "full":
        mask[:] = True
    elif kind == "comb":
        mask[:] = False
        mask[:, ::2] = True
        mask[-1] = True
    fg = table(spark, mask, "fg").where("fg").select("row", "col")
    got = {(r.row, r.col): r.component for r in co.connected_components(fg, E, tile=4).collect()}
    assert got == bfs_labels(mask)


def test_component_axis(spark):
    pts = [(r, c) for r in range(20) for c in range(20) if abs((19 - r) - c) <= 1]
    df = spark.createDataFrame(pts, "row int, col int").withColumn("component", F.lit(0))
    axis = co.largest_component(df).first()
    xy = np.array([(c, -r) for r, c in pts], float)
    val, vec = np.linalg.eigh(np.cov((xy - xy.mean(axis=0)).T))
    assert axis.elongation == pytest.approx(math.sqrt(val[1] / val[0]))
    assert axis.bearing_deg == pytest.approx(math.degrees(math.atan2(*vec[:, 1])) % 180)
    assert axis.px == len(pts) and axis.n_components == 1


def test_canny_finds_a_square(spark):
    x = np.zeros((60, 60))
    x[20:40, 20:40] = 1.0
    df = table(spark, x).withColumn("valid", F.lit(True))
    edges, limits = ed.canny(df, "v", focal.Extent(60, 60), tile=24, dense=True)
    got = {(r.row, r.col) for r in edges.collect()}
    assert got and all(min(abs(r - 19.5), abs(r - 39.5)) < 2 or min(abs(c - 19.5), abs(c - 39.5)) < 2 for r, c in got)
    lim = limits.first()
    assert lim.low == pytest.approx(0.4 * lim.high)


@pytest.mark.parametrize("density", [0.02, 0.3])
def test_nearest_distance(spark, rng, density):
    src = rng.random(SHAPE) < density
    src[3, 4] = True
    grid = table(spark, np.zeros(SHAPE))
    cells = table(spark, src, "s").where("s").select("row", "col").union(spark.createDataFrame([(-3, 10)], "row int, col int"))
    got = array(ve.nearest_distance(grid, cells, E, (10.0, 12.0), strip=4), "distance", SHAPE)
    ys, xs = np.append(np.nonzero(src)[0], -3), np.append(np.nonzero(src)[1], 10)
    r, c = np.indices(SHAPE)
    want = np.sqrt(((r[..., None] - ys) * 10.0) ** 2 + ((c[..., None] - xs) * 12.0) ** 2).min(axis=-1)
    np.testing.assert_allclose(got, want)


def test_no_source_means_null(spark):
    grid = table(spark, np.zeros((4, 4)))
    none = spark.createDataFrame([], "row int, col int")
    assert ve.nearest_distance(grid, none, focal.Extent(4, 4)).where("distance is null").count() == 16


def test_decimate_integer_factor_is_block_mean(spark, rng):
    x = rng.random((24, 12))
    got = array(rs.decimate(table(spark, x), ["v"], focal.Extent(24, 12), 8), "v", (8, 4))
    np.testing.assert_allclose(got, x.reshape(8, 3, 4, 3).mean(axis=(1, 3)))


def test_upsample_of_a_constant(spark):
    x = np.full((6, 6), 7.0)
    for kernel in ("bilinear", "cubic"):
        up = rs.upsample(table(spark, x), "v", 2, kernel, focal.Extent(6, 6), tile=16)
        np.testing.assert_allclose(array(up, "v", (12, 12)), 7.0)


def plain_warp(array, affine, target, method):
    a, _, c, _, e, f = affine
    fn, radius = rs.KERNELS.get(method, (None, 0))
    out = {}
    for r in range(target.rows):
        for k in range(target.cols):
            x, y = target.affine[2] + (k + 0.5) * target.affine[0], target.affine[5] + (r + 0.5) * target.affine[4]
            py, px = (y - f) / e, (x - c) / a
            i, j = math.floor(py), math.floor(px)
            if not (0 <= i < array.shape[0] and 0 <= j < array.shape[1]):
                continue
            if fn is None:
                out[r, k] = array[i, j]
                continue
            total = weight = 0.0
            for y0 in range(i - 2, i + 3):
                for x0 in range(j - 2, j + 3):
                    w = fn(py - 0.5 - y0) * fn(px - 0.5 - x0)
                    if w and 0 <= y0 < array.shape[0] and 0 <= x0 < array.shape[1] and not np.isnan(array[y0, x0]):
                        total, weight = total + w * array[y0, x0], weight + w
            out[r, k] = total / weight if abs(weight) > 1e-9 else np.nan
    return out


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("target", [
    rs.Grid((4.0, 0.0, 103.3, 0.0, -4.0, 989.1), 60, 45), rs.Grid((23.0, 0.0, 60.0, 0.0, -31.0, 1040.0), 12, 14), rs.Grid((10.0, 0.0, 100.0, 0.0, -10.0, 1000.0), 20, 17),
])
def test_warp(spark, rng, method, target):
    source = rng.integers(0, 50, (20, 17)).astype(float)
    source[rng.random(source.shape) < 0.15] = np.nan
    affine = (10.0, 0.0, 100.0, 0.0, -10.0, 1000.0)
    rows = [(y, int(r), int(c), None if np.isnan(source[r, c]) else float(source[r, c] * y)) for y in (1, 2) for r in range(20) for c in range(17)]
    df = spark.createDataFrame(rows, "year int, row int, col int, v double")
    found = rs.warp(df, ["v"], affine, target, method, keys=["year"], tile=6).collect()
    for year in (1, 2):
        want = plain_warp(source * year, affine, target, method)
        got = {(r["row"], r["col"]): np.nan if r["v"] is None else r["v"] for r in found if r["year"] == year}
        assert got.keys() == want.keys()
        assert np.allclose([got[k] for k in want], list(want.values()), equal_nan=True)
