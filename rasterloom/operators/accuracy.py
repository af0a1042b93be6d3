"""Accuracy of a classification, on long confusion matrices (ref, pred, n).
Everything after the first group-by works on a handful of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def confusion_matrix(pairs: DataFrame, ref: str = "ref", pred: str = "pred", by=()) -> DataFrame:
    return pairs.groupBy(*by, F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_accuracy(cm: DataFrame, by=()) -> DataFrame:
    """Producer's and consumer's accuracy per class; 0 without samples."""
    by = list(by)
    # one row per matrix margin: the class seen as reference, as prediction
    sides = F.array(
        F.struct(F.col("ref").alias("class"), F.col("n").alias("as_ref"), F.lit(0).cast("bigint").alias("as_pred"),
                 F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0).cast("bigint").alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("as_ref"), F.col("n").alias("as_pred"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    return (
        cm.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
        .groupBy(*by, "class")
        .agg(F.sum("as_ref").alias("n_ref"), F.sum("as_pred").alias("n_pred"), F.sum("hit").alias("n_hit"))
        .withColumns({
            "producers_accuracy": _ratio(F.col("n_hit"), F.col("n_ref")),
            "consumers_accuracy": _ratio(F.col("n_hit"), F.col("n_pred")),
        })
    )


def overall_accuracy(cm: DataFrame, by=()) -> DataFrame:
    """Overall accuracy and kappa."""
    per_class = class_accuracy(cm, by)
    sums = per_class.groupBy(*by).agg(
        F.sum("n_ref").alias("n"), F.sum("n_hit").alias("hits"),
        F.sum(F.col("n_ref") * F.col("n_pred")).alias("chance"),
    )
    oa = F.col("hits") / F.col("n")
    pe = F.col("chance") / (F.col("n") * F.col("n"))
    kappa = (oa - pe) / F.nullif(1.0 - pe, F.lit(0.0))
    return sums.select(*by, "n", oa.alias("oa"), kappa.alias("kappa"))


def _weighted_rows(cm: DataFrame, weights: DataFrame) -> DataFrame:
    """(ref, pred, n, n_i, w, cond, p): rows are reference classes, weights
    are normalised to 1. Every class of either side or of the weights is
    there; one without samples has a single row without a prediction, one
    without a weight has weight 0."""
    totals = cm.groupBy("ref").agg(F.sum("n").alias("n_i"))
    norm = weights.agg(F.sum("w").alias("w_sum")).withColumn("_k", F.lit(1))
    w = (
        weights.withColumn("_k", F.lit(1)).join(norm, "_k")
        .select(F.col("class").alias("ref"), F.coalesce(F.col("w") / F.nullif(F.col("w_sum"), F.lit(0.0)), F.col("w")).alias("w"))
    )
    cond = _ratio(F.col("n").cast("double"), F.col("n_i"))
    sides = cm.select(F.explode(F.array("ref", "pred")).alias("ref")).unionByName(weights.select(F.col("class").alias("ref")))
    frame = sides.where("ref IS NOT NULL").distinct()
    rows = frame.join(w, "ref", "left").join(totals, "ref", "left").join(cm, "ref", "left")
    rows = rows.na.fill({"w": 0.0}).withColumns({"n": F.coalesce("n", F.lit(0)), "n_i": F.coalesce("n_i", F.lit(0))})
    return rows.withColumns({"cond": cond, "p": cond * F.col("w")})


def area_weighted_accuracy(cm: DataFrame, weights: DataFrame) -> DataFrame:
    """Simple and area-weighted overall accuracy with its standard error and
    95 % interval. `weights` is (class, w)."""
    r = _weighted_rows(cm, weights)
    diag = F.col("ref") == F.col("pred")
    c, n = F.col("cond"), F.col("n_i")
    spread = F.when(diag & (n > 1), F.col("w") * F.col("w") * c * (1.0 - c) / (n - 1)).otherwise(0.0)
    agg = r.agg(
        (F.sum(F.when(diag, F.col("n")).otherwise(0)) / F.sum("n")).alias("oa_simple"),
        F.sum(F.when(diag, F.col("p")).otherwise(0.0)).alias("oa_weighted"),
        F.sqrt(F.sum(spread)).alias("se"),
    )
    margin = F.lit(Z95) * F.col("se")
    return agg.select(
        "oa_simple", "oa_weighted", "se", margin.alias("margin95"),
        (F.col("oa_weighted") - margin).alias("ci95_low"), (F.col("oa_weighted") + margin).alias("ci95_high"),
    )


def area_weighted_classes(cm: DataFrame, weights: DataFrame) -> DataFrame:
    """Per class: weighted producer's and user's accuracy, the estimated
    area proportion, the weight used and the sample size."""
    r = _weighted_rows(cm, weights)
    diag = F.when(F.col("ref") == F.col("pred"), F.col("p")).otherwise(0.0)
    by_ref = r.groupBy(F.col("ref").alias("class")).agg(
        F.sum(diag).alias("hit"), F.first("w").alias("weight"), F.first("n_i").alias("n_ref")
    )
    by_pred = r.where("pred IS NOT NULL").groupBy(F.col("pred").alias("class")).agg(F.sum("p").alias("estimated_proportion"))
    both = by_ref.join(by_pred, "class", "left")
    est = F.coalesce("estimated_proportion", F.lit(0.0))
    return both.select(
        "class", _ratio(F.col("hit"), F.col("weight")).alias("producer_weighted"),
        _ratio(F.col("hit"), est).alias("user_weighted"), est.alias("estimated_proportion"), "weight", "n_ref",
    )


def class_area_confidence(cm: DataFrame, weights: DataFrame, total_ha: float | Column, cls: int = 3) -> DataFrame:
    """Estimated share of one class with its 95 % margin in points and
    hectares; reference classes with at most one sample are skipped."""
    total = total_ha if isinstance(total_ha, Column) else F.lit(float(total_ha))
    r = _weighted_rows(cm, weights).where((F.col("pred") == cls) & (F.col("n_i") > 1))
    c = F.col("cond")
    agg = r.agg(
        F.coalesce(F.sum("p"), F.lit(0.0)).alias("p_hat"),
        F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w") * c * (1.0 - c) / (F.col("n_i") - 1)), F.lit(0.0))).alias("se"),
    )
    m = F.lit(Z95) * F.col("se")
    return agg.select(
        F.lit(cls).alias("class"), "p_hat", "se",
        (100.0 * m).alias("margin95_points"), (m * total).alias("margin95_ha"),
        (100.0 * (F.col("p_hat") - m)).alias("ci95_low_pct"), (100.0 * (F.col("p_hat") + m)).alias("ci95_high_pct"),
        ((F.col("p_hat") - m) * total).alias("ci95_low_ha"), ((F.col("p_hat") + m) * total).alias("ci95_high_ha"),
    )
