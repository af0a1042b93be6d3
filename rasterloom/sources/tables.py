"""Readers for pixel tables, training points and earlier results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import config as cfg
from rasterloom import schema
from rasterloom.functions.columns import null_if_not_finite, require_columns
from rasterloom.operators.points import validate_training_points


def read_raster(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, bands: Sequence[str] = tuple(cfg.BANDS),
    nodata: float | None = None, window: tuple[int, int, int, int] | None = None, declared: T.StructType | None = None,
) -> DataFrame:
    """Pixel table with NULL as the only missing marker. Years prune
    partitions and the row/column window prunes row groups; both are plain
    comparisons below the missing-value rules."""
    reader = spark.read if declared is None else spark.read.schema(declared)
    df = reader.parquet(path)
    require_columns(df, ["row", "col", *bands])
    if years is not None:
        df = df.where(F.col("year").isin(*years))
    if window is not None:
        r0, r1, c0, c1 = window
        df = df.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    fixes = {}
    for b in bands:
        x = F.col(b)
        if isinstance(df.schema[b].dataType, (T.FloatType, T.DoubleType)):
            x = null_if_not_finite(x)
        fixes[b] = x if nodata is None else F.nullif(x, F.lit(nodata))
    return df.withColumns(fixes)


def read_optional(spark: SparkSession, path: str, declared: T.StructType | None = None) -> DataFrame | None:
    """A table that may be absent, such as a cloud mask."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return (spark.read if declared is None else spark.read.schema(declared)).parquet(path)


def read_csv(spark: SparkSession, path: str, declared: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is cut."""
    reader = spark.read.option("header", True)
    df = reader.csv(path) if declared is None else reader.schema(declared).option("enforceSchema", True).csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_training_points(spark: SparkSession, base: str) -> DataFrame | None:
    """First of <base>.geojson, .csv, .parquet that exists, validated."""
    from rasterloom.sources.vectors import point_features, read_geojson

    jvm = spark._jvm.org.apache.hadoop.fs
    def exists(p):
        path = jvm.Path(p)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if exists(f"{base}.geojson"):
        pts = point_features(read_geojson(spark, f"{base}.geojson"))
        label = F.coalesce(F.col("props")["class"], F.col("props")["label"])
        return validate_training_points(pts.select("x", "y", label.try_cast("int").alias("class")))
    if exists(f"{base}.csv"):
        df = validate_training_points(read_csv(spark, f"{base}.csv"))
        return df.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "class": F.col("class").try_cast("int")})
    if exists(f"{base}.parquet"):
        return validate_training_points(spark.read.parquet(f"{base}.parquet"))
    return None


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Earlier JSON results, one document per line."""
    return spark.read.json(path)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SCENES).parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.OBSERVATIONS).parquet(path)
