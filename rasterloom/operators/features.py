"""Feature tables: one row per pixel or point, bands, indices, class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.columns import require_columns
from rasterloom.functions.spectral import add_indices
from rasterloom.operators.change import with_class_name


def feature_table(df: DataFrame, year: int | None = None, label: str | None = None) -> DataFrame:
    """year, bands, indices and, with a label, class and class name."""
    require_columns(df, ["B3", "B4", "B8", "B11"])
    out = df if year is None else df.withColumn("year", F.lit(year))
    out = add_indices(out)
    names = [c for c in ["year", "row", "col", *cfg.BANDS, *cfg.INDICES] if c in out.columns]
    if label is None:
        return out.select(*names)
    return with_class_name(out.select(*names, F.col(label).alias("class")))


def combine_years(tables: dict[int, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union of yearly tables in year order; no tables give an empty one."""
    if not tables:
        spark = spark or SparkSession.active()
        columns = ", ".join(f"{c} double" for c in cfg.FEATURES_9)
        return spark.createDataFrame([], f"year int, {columns}")
    ordered = [tables[y] for y in sorted(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)


def stack(left: DataFrame, right: DataFrame, keys=("row", "col")) -> DataFrame:
    """Bands of two rasters side by side; a pixel missing in one is masked."""
    return left.join(right, list(keys))


def merge_collections(*tables: DataFrame) -> DataFrame:
    """Union of feature collections with differing properties."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def image_difference(a: DataFrame, b: DataFrame, value: str, keys=("row", "col")) -> DataFrame:
    other = b.select(*keys, F.col(value).alias("_b"))
    return a.join(other, list(keys)).select(*keys, (F.col(value) - F.col("_b")).alias(value))
