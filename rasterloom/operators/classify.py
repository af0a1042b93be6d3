"""Random Forest land-cover classification with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.operators import accuracy as ac
from rasterloom.operators import sampling as sa
from rasterloom.session import checkpoint

MAX_DEPTH = 30
FIT_PARTITIONS = 8


def steady(df: DataFrame, keys: Sequence[str], partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Fixed partitioning and order, so that a seeded fit is repeatable."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def train(
    samples: DataFrame, features: Sequence[str], label: str = "class", trees: int = cfg.N_TREES,
    seed: int = cfg.SEED, keys: Sequence[str] = ("row", "col"), depth: int = MAX_DEPTH,
) -> PipelineModel:
    """Fit on a sample table (a few hundred rows per class)."""
    data = checkpoint(steady(samples.select(*keys, label, *features), keys))
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(
        steady(data, keys)
    )


def classify(model: PipelineModel, pixels: DataFrame) -> DataFrame:
    """Class of every pixel; pixels with a missing feature are masked. A
    projection without a shuffle; the model travels to the executors."""
    names = model.stages[0].getInputCols()
    usable = pixels.dropna(subset=names)
    predicted = model.transform(usable).withColumn("class", F.col("prediction").cast("int"))
    return predicted.drop("features", "rawPrediction", "probability", "prediction")


def evaluate(model: PipelineModel, test: DataFrame, label: str = "class") -> DataFrame:
    """Confusion matrix (ref, pred, n) on held-out rows."""
    named = test.withColumnRenamed(label, "_ref")
    return ac.confusion_matrix(classify(model, named), "_ref", "class")


def importances(model: PipelineModel) -> DataFrame:
    from pyspark.sql import SparkSession

    names = model.stages[0].getInputCols()
    values = model.stages[1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def compare_feature_sets(
    samples: DataFrame, sets: dict[str, Sequence[str]], label: str = "class", keys: Sequence[str] = ("row", "col"),
    trees: int = cfg.N_TREES, seed: int = cfg.SEED, depth: int = MAX_DEPTH, minimum: int | None = None,
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """One exact per-class split, one model per feature set, scored on the
    same held-out rows. Returns the scores, best first, and the models."""
    if minimum is not None:
        sa.check_class_sizes(samples, label, minimum)
    split = checkpoint(sa.exact_split(samples, seed, keys, label))
    learn, test = split.where("is_train"), split.where(~F.col("is_train"))
    models, scores = {}, None
    for name, features in sets.items():
        models[name] = train(learn, features, label, trees, seed, keys, depth)
        cm = evaluate(models[name], test, label)
        row = ac.overall_accuracy(cm).select(
            F.lit(name).alias("feature_set"), F.lit(len(features)).alias("n_features"), "oa", "kappa", F.col("n").alias("test_n"),
        )
        scores = row if scores is None else scores.unionByName(row)
    return scores.orderBy(F.desc("oa"), F.desc("kappa"), "n_features"), models


def best_set(scores: DataFrame) -> str:
    """Name of the winner by (oa, kappa): one row reaches the driver."""
    return scores.limit(1).first()["feature_set"]


def save(model: PipelineModel, path: str) -> None:
    """Freeze the reference year's model for the other years."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def final_model(
    labelled: DataFrame, extra_pixels: DataFrame, extra_region, extra_class: int = 1, features: Sequence[str] = tuple(cfg.FEATURES_9),
    per_class: int = cfg.SAMPLES_PER_CLASS, oversample: int = cfg.WATER_OVERSAMPLE, extra: int = cfg.HAND_POINTS,
    seed: int = cfg.SEED, keys=("row", "col"), trees: int = cfg.N_TREES, depth: int = MAX_DEPTH,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Cleaned sample, 70/30 split, plus hand-picked region samples of one
    class from another year's composite, added to the training part.
    Returns (model, train, test)."""
    sample, _ = sa.cleaned_sample(labelled, per_class, oversample, seed=seed, keys=keys, features=features)
    sample = checkpoint(sample)
    learn, test = sa.train_test_split(sample, seed, keys)
    hand = sa.sample_region(extra_pixels.dropna(subset=list(features)), extra_region, extra, seed, keys)
    hand = hand.withColumns({"class": F.lit(extra_class), "source": F.lit("hand")})
    augmented = learn.unionByName(hand, allowMissingColumns=True)
    return train(augmented, features, trees=trees, seed=seed, keys=keys, depth=depth), augmented, test
