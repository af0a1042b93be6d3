import json
from pathlib import Path

import numpy as np
import pytest
from rasters import table
from pyspark.sql import functions as F

from rasterloom import config as cfg, sinks
from rasterloom.catalog import load
from rasterloom.operators import features as fe, focal, scenes as sc
from rasterloom.plans import eda, land_change, site
from rasterloom.session import broadcast_if_small, checkpoint
from rasterloom.sources import tables as tb, vectors as vs
from rasterloom.streaming import incremental as inc

AFFINE = (10.0, 0.0, 600000.0, 0.0, -10.0, 1200000.0)
AOI = [[(600020.0, 1199600.0), (600380.0, 1199600.0), (600380.0, 1199980.0), (600020.0, 1199980.0)]]
N = 40


def pixels(spark, years=(2020, 2022), seed=1):
    """Two smooth scenes with a bright built-up block that grows."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, year in enumerate(years):
        for r in range(N):
            for c in range(N):
                built = 10 <= r < 18 + 6 * k and 10 <= c < 30
                base = [600, 800, 900, 3200, 1800, 1200] if not built else [1500, 1600, 1700, 1900, 3200, 2500]
                if r >= 34:
                    base = [900, 1400, 700, 300, 200, 150]
                if c >= 34:
                    base = [1200, 1500, 1800, 2300, 2200, 2100]
                rows.append((year, r, c, *[int(b + rng.integers(-60, 60)) for b in base]))
    names = ", ".join(f"{b} int" for b in cfg.BANDS)
    return spark.createDataFrame(rows, f"year int, row int, col int, {names}")


def classes_of(df):
    return df.withColumn("class", F.when(F.col("row") >= 34, 0).when(F.col("col") >= 34, 2)
                         .when(F.col("row").between(10, 17) & F.col("col").between(10, 29), 3).otherwise(1))


def test_raster_round_trip(spark, folder):
    df = pixels(spark)
    sinks.write_raster(df, f"{folder}/raster", tile=16)
    back = tb.read_raster(spark, f"{folder}/raster", years=[2022], window=(5, 10, 0, 7), nodata=800)
    assert back.count() == 35 and back.where("B3 = 800").isEmpty()
    assert df.where("B3 = 800").count() == tb.read_raster(spark, f"{folder}/raster", nodata=800).where("B3 is null").count()
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "LessThan(row,10)" in plan
    with pytest.raises(ValueError):
        tb.read_raster(spark, f"{folder}/raster", bands=["B99"])


def test_resume_writes_only_missing_years(spark, folder):
    path = f"{folder}/out"
    df = pixels(spark).select("year", "row", "B2")
    sinks.write_missing_years(df.where("year = 2020"), path)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("year=2020/*.parquet")}
    sinks.write_missing_years(df.withColumn("B2", F.lit(-1)), path, [2020, 2022])
    assert before == {p: p.stat().st_mtime_ns for p in Path(path).rglob("year=2020/*.parquet")}
    got = {r.year: r.lo for r in spark.read.parquet(path).groupBy("year").agg(F.min("B2").alias("lo")).collect()}
    assert got[2022] == -1 and got[2020] > 0
    assert sinks.existing_years(spark, path) == {2020, 2022}


def test_csv_and_names(spark, folder):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "name string, n int")
    assert sinks.write_csv(df, f"{folder}/t")
    assert tb.read_csv(spark, f"{folder}/t", "name string, n int").agg(F.sum("n")).first()[0] == 6
    empty = df.where("false")
    assert not sinks.write_csv(empty, f"{folder}/none") and not Path(f"{folder}/none").exists()
    assert sinks.write_csv(empty, f"{folder}/head", keep_header_when_empty=True)
    assert spark.read.text(f"{folder}/head").first().value == "name,n"
    sinks.write_names(df, "name", f"{folder}/names")
    assert [r.value for r in spark.read.text(f"{folder}/names").collect()] == ["a", "b"]
    Path(folder, "bom.csv").write_text("name,n\nx,1\n", encoding="utf-8-sig")
    assert tb.read_csv(spark, f"{folder}/bom.csv").columns == ["name", "n"]
    sinks.write_json(df, f"{folder}/json")
    assert tb.read_results(spark, f"{folder}/json").count() == 3
    assert json.loads(sinks.to_document(df).first().value) == {"name": "b", "n": 1}


def test_geojson(spark, folder):
    def feature(kind, coords, **props):
        return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        feature("LineString", [[0, 0], [3, 4]], name="A"), feature("MultiLineString", [[[0, 0], [1, 0]], [[2, 0], [2, 5], [2, 6]]]),
        feature("Polygon", [ring]), feature("MultiPolygon", [[ring, [[4, 4], [6, 4], [6, 6], [4, 4]]]]),
        feature("Point", [1.5, 2.5], label=3),
    ]}
    Path(folder, "f.geojson").write_text(json.dumps(doc, indent=1))
    f = vs.read_geojson(spark, f"{folder}/f.geojson")
    lines = vs.line_features(f)
    assert lines.count() == 3
    from rasterloom.operators import vectors as ve

    segs = ve.line_segments(vs.named_properties(lines, ["name"]).select("fid", "name", "coords"))
    assert segs.count() == 4 and segs.agg(F.sum(ve.segment_length())).first()[0] == pytest.approx(12.0)
    assert len(vs.rings_of(vs.polygon_features(f))) == 3
    pts = tb.read_training_points(spark, f"{folder}/f")
    assert pts.first().asDict() == {"x": 1.5, "y": 2.5, "class": 3}
    assert tb.read_training_points(spark, f"{folder}/nothing") is None
    sinks.write_geojson(lines.withColumn("c", F.transform("coords", lambda p: F.array(p["x"], p["y"]))), f"{folder}/out", "LineString", "c", ["fid"])
    again = vs.line_features(vs.read_geojson(spark, f"{folder}/out", lines=True))
    assert sorted(len(r.coords) for r in again.collect()) == [2, 2, 3]
    row = sinks.provenance(spark, "somewhere", f, (0, 0, 1, 1), "A").first()
    assert row.n_features == 5 and row.bbox == [0.0, 0.0, 1.0, 1.0]


def test_checkpoint_and_broadcast_bound(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert checkpoint(df).agg(F.sum("v")).first()[0] == 9900
    def hinted(d):
        return "broadcast" in d._jdf.queryExecution().logical().toString()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, max_rows=10))


def test_combine_years(spark):
    df = pixels(spark)
    both = fe.combine_years({y: fe.feature_table(df.where(F.col("year") == y)) for y in (2022, 2020)})
    assert both.count() == 2 * N * N and set(cfg.FEATURES_9) < set(both.columns)
    empty = fe.combine_years({}, spark)
    assert empty.columns == ["year", *cfg.FEATURES_9] and empty.isEmpty()


def test_streaming_sample_equals_batch_sample(spark, folder):
    from rasterloom.operators.sampling import sample_pixels

    df = pixels(spark).select("year", "row", "col", "B2")
    for i, part in enumerate(df.randomSplit([0.4, 0.3, 0.3], seed=3)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in/batch{i}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    inc.update_sample(stream, f"{folder}/state", k=100).awaitTermination()
    got = {tuple(r) for r in inc.current_sample(spark, f"{folder}/state").select("year", "row", "col").collect()}
    assert got == {tuple(r) for r in sample_pixels(df, 100).select("year", "row", "col").collect()} and len(got) == 200


def test_streaming_years(spark, folder):
    df = pixels(spark).select("year", "row", "col", "B2")
    df.where("year = 2020").write.parquet(f"{folder}/in/a")
    def run():
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        inc.extend_years(stream, lambda b: b.groupBy("year").agg(F.count("*").alias("n")), f"{folder}/out", f"{folder}/cp").awaitTermination()
    run()
    df.where("year = 2022").write.parquet(f"{folder}/in/b")
    run()
    assert {r.year: r.n for r in spark.read.parquet(f"{folder}/out").collect()} == {2020: N * N, 2022: N * N}
    df.where("year = 2022").limit(3).write.parquet(f"{folder}/in/late")
    with pytest.raises(Exception, match="arrived late"):
        run()


def test_exploratory_plan(spark, folder):
    pts = spark.createDataFrame([(600055.0 + 20 * i, 1199905.0 - 15 * i, i % 4) for i in range(12)], "x double, y double, class int")
    out = eda.run(pixels(spark), f"{folder}/eda", AFFINE, aoi=AOI, points=pts, per_year=300)
    counts = {r.year: r for r in out["pixel_counts"].collect()}
    assert counts[2020].valid == 36 * 38 and counts[2020].sampled == 300
    assert out["feature_dataset"].count() == 600
    ready = {r.item: r.ok for r in out["readiness"].collect()}
    assert all(ready.values())
    report = spark.read.json(f"{folder}/eda/qc_report").where("year = 2020").first().report
    assert "pixels 1600 = " in report and "B11" in report and "no-B11" not in report and "cells of 10.00 by 10.00" in report
    summary, shares = eda.yearly_summary(out["feature_dataset"], out["pixel_counts"], 2020)
    assert summary.count() == 9 and shares.first().valid_pct == pytest.approx(100 * 36 * 38 / N**2)
    assert out["class_counts"].agg(F.sum("n")).first()[0] == 12


def test_change_plan(spark, folder):
    p = pixels(spark)
    obs = p.withColumns({
        "scene_id": F.concat(F.lit("S"), F.col("year").cast("string")), "ts": F.make_timestamp_ntz("year", F.lit(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
        "scl": F.lit(4),
    }).drop("year")
    scenes = obs.select("scene_id", "ts").distinct().withColumn("cloud_pct", F.lit(5.0))
    codes = {0: 80, 1: 10, 2: 60, 3: 50}
    lookup = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    labels = classes_of(p.where("year = 2020")).select("row", "col", lookup[F.col("class")].alias("wc"))
    region = (F.col("row") < 8) & (F.col("col") < 30)
    args = dict(reference_year=2020, hand_year=2022, hand_region=region, year_from=2020, year_to=2022, per_class=60, trees=10)
    out = land_change.run(obs, scenes, labels, [2020, 2022], f"{folder}/change", **args)
    assert out["accuracy"].first().oa > 0.95
    area = {(r.year, r["class"]): r.n for r in out["class_area"].collect()}
    assert area[2020, 3] == pytest.approx(160, abs=10) and area[2022, 3] == pytest.approx(280, abs=10)
    assert out["transition_flows"].first().flow == "Vegetation → Built-up"
    assert sum(r.ha for r in out["transition"].collect()) == pytest.approx(N * N * 0.01)
    stamp = {q: q.stat().st_mtime_ns for q in Path(folder, "change", "classified").rglob("*.parquet")}
    land_change.run(obs, scenes, labels, [2020, 2022], f"{folder}/change", **args)
    assert stamp == {q: q.stat().st_mtime_ns for q in Path(folder, "change", "classified").rglob("*.parquet")}


def test_site_plan(spark, folder):
    p = pixels(spark)
    scaled = p.withColumns({b: F.col(b) / 10000 for b in cfg.BANDS})
    extent = focal.Extent(N, N)
    features, edges, limits = site.scene_features(scaled, extent, tile=32)
    features, edges = checkpoint(features), checkpoint(edges)
    assert features.count() == 2 * N * N and limits.count() == 2 and not edges.isEmpty()
    labels = classes_of(p.where("year = 2020")).select("row", "col", "class")
    scores, classified = site.class_maps(features, labels, 2020, trees=10, per_class=60, minimum=20)
    assert scores.count() == 3 and scores.agg(F.max("oa")).first()[0] > 0.9
    classified = checkpoint(classified)
    roads = spark.createDataFrame([(1, 600000.0, 1199700.0, 600400.0, 1199700.0)], "fid int, x1 double, y1 double, x2 double, y2 double")
    rings, bands = site.zone_tables(classified, [2020, 2022], AFFINE, (600200.0, 1199800.0), roads, extent)
    assert rings.count() == 48 and bands.agg(F.sum("zone_ha")).first()[0] == pytest.approx(2 * N * N * 0.01)
    summary, grouped, axis, lines = site.line_analysis(edges, classified, AOI, AFFINE, extent, min_length_m=60)
    assert axis.count() == 2 and summary.count() == 2 and lines.count() > 0
    assert axis.where("year = 2022").first().px == pytest.approx(280, abs=15)


def test_every_query_has_a_reader():
    queries, oracles = load()
    assert len(queries) > 100 and set(oracles) <= set(queries)


def test_quantiles_split_a_crowded_bucket(spark, rng):
    """One far outlier presses everything else into a single bucket."""
    from rasterloom.operators.quantiles import exact_quantiles

    a = np.r_[rng.normal(size=3000), np.full(500, 0.25), 1e9]
    b = np.r_[rng.normal(size=800) * 1e-6, -1e300, 1e300]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "k string, v double")
    probs = [0.0, 0.013, 0.5, 0.75, 0.999, 1.0]
    got = {(r.k, r.p): r.q for r in exact_quantiles(df, ["k"], "v", probs, buckets=64, limit=50).collect()}
    for k, x in (("a", a), ("b", b)):
        for p in probs[:5]:
            assert got[k, p] == pytest.approx(np.quantile(x, p), rel=1e-9)
        assert got[k, 1.0] == x.max()
    alone = {r.p: r.q for r in exact_quantiles(df.where("k = 'a'"), [], "v", probs, buckets=16, limit=10).collect()}
    assert alone[0.5] == pytest.approx(np.median(a))
