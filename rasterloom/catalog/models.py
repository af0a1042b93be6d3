"""Classification. Models have no SQL equivalent; rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import composite, composite_table, grid, labelled, query, rounded
from rasterloom.operators import accuracy as ac, change as ch, classify as cl, sampling as sa
from rasterloom.session import checkpoint

KEYS = ("year", "row", "col")


def _samples(spark, d, table=None):
    rows = labelled(spark, d, table).select(*KEYS, *cfg.FEATURES_9, "class")
    return sa.stratified_sample(rows, keys=KEYS)


def _model(spark, d, table=None):
    learn, test = sa.train_test_split(checkpoint(_samples(spark, d, table)), keys=KEYS)
    return cl.train(learn, cfg.FEATURES_9, keys=KEYS), test


@query("rf_predict")
def rf_predict(spark, d):
    """Every pixel of every year classified, then the area table. The medians
    cost more than the forest, so the composite is written once for both."""
    table = composite_table(spark, d)
    model, _ = _model(spark, d, table)
    return rounded(ch.class_area_table(cl.classify(model, table)), "area_ha", "area_pct")


@query("rf_evaluate")
def rf_evaluate(spark, d):
    model, test = _model(spark, d)
    return rounded(ac.overall_accuracy(cl.evaluate(model, test)), "oa", "kappa")


@query("rf_importance")
def rf_importance(spark, d):
    return rounded(cl.importances(_model(spark, d)[0]), "importance")


@query("rf_compare_feature_sets")
def rf_compare_feature_sets(spark, d):
    scores, _ = cl.compare_feature_sets(
        _samples(spark, d), {"nine": cfg.FEATURES_9, "five": cfg.FEATURES_5}, keys=KEYS)
    return rounded(scores, "oa", "kappa")


@query("rf_final_model")
def rf_final_model(spark, d):
    """Cleaned samples plus region samples from another year."""
    lab = grid(spark, d).select("row", "col", (F.col("v") % 4).cast("int").alias("class"))
    c = checkpoint(composite(spark, d))
    ground = c.where("year = 1998").join(lab, ["row", "col"])
    region = F.col("row").between(10, 90) & F.col("col").between(20, 70)
    model, train, test = cl.final_model(ground, c.where("year = 1996"), region)
    return rounded(ac.class_accuracy(cl.evaluate(model, test)), "producers_accuracy", "consumers_accuracy")
