"""Composites to change: classify every year, compare two dates, test the
change against the accuracy of the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg, sinks
from rasterloom.operators import accuracy as ac, change as ch, classify as cl, focal, scenes as sc, statistics as st
from rasterloom.session import checkpoint


def classified_filtered(model, composite: DataFrame, extent: focal.Extent) -> DataFrame:
    """Class map of every year after the 3 x 3 majority filter."""
    raw = cl.classify(model, composite).select("year", "row", "col", "class")
    return focal.majority(raw, extent, keys=["year"])


def run(
    obs: DataFrame, scenes: DataFrame, labels: DataFrame, years: Sequence[int], out: str,
    reference_year: int, hand_year: int, hand_region, year_from: int, year_to: int,
    per_class: int = cfg.SAMPLES_PER_CLASS, trees: int = cfg.N_TREES,
) -> dict[str, DataFrame]:
    """Every step is written under `out` as it finishes and found again on
    the next run, year by year, so an interrupted run resumes."""
    spark = obs.sparkSession
    sinks.write_missing_years(sc.build_composite(obs, scenes, years), f"{out}/composite", years)
    composite = spark.read.parquet(f"{out}/composite")
    extent = focal.raster_extent(composite)
    ground = composite.where(F.col("year") == reference_year).join(
        labels.select("row", "col", ch.remap_landcover(F.col("wc")).alias("class")), ["row", "col"])
    model, _, test = cl.final_model(
        ground, composite.where(F.col("year") == hand_year), hand_region, per_class=per_class, trees=trees)
    sinks.write_missing_years(classified_filtered(model, composite, extent), f"{out}/classified", years)
    classified = spark.read.parquet(f"{out}/classified")

    cm = checkpoint(cl.evaluate(model, test))
    weights = ground.where(F.col("class") >= 0).groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("w"))
    weights = checkpoint(weights)
    area = checkpoint(ch.class_area_table(classified))
    total = area.where(F.col("year") == year_to).agg(F.sum("area_ha").alias("ha")).first()["ha"] or 0.0
    interval = checkpoint(ac.class_area_confidence(cm, weights, total))
    margin = interval.first()["margin95_ha"]
    matrix = checkpoint(ch.transition_matrix(
        classified.where(F.col("year") == year_from), classified.where(F.col("year") == year_to)))
    built = area.where(F.col("class") == cfg.BUILT_UP).select("year", F.col("area_ha").alias("ha"))
    tables = {
        "confusion_matrix": cm, "accuracy": ac.overall_accuracy(cm), "class_accuracy": ac.class_accuracy(cm),
        "area_weighted": ac.area_weighted_accuracy(cm, weights), "area_weighted_classes": ac.area_weighted_classes(cm, weights),
        "class_area_ci": interval, "class_area": area, "transition": matrix,
        "transition_summary": ch.transition_summary(matrix), "transition_flows": ch.transition_flows(matrix),
        "ndbi_histogram": st.fixed_histogram(composite, "NDBI"), "ndbi_summary": st.value_summary(composite, "NDBI"),
        "positive_share": st.positive_share(composite), "change_significance": ch.change_significance(built, margin),
    }
    for name, table in tables.items():
        sinks.write_json(table, f"{out}/{name}")
    return tables
