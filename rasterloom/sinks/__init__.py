"""Writers: rasters, tables, documents, features, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.operators.focal import TILE


def write_raster(df: DataFrame, path: str, tile: int = TILE, mode: str = "overwrite") -> None:
    """Pixel table partitioned by year and clustered by tile: ranges of tiles
    give even files, and sorted rows give row-group statistics that window
    reads can skip by."""
    tiles = df.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})
    ordered = tiles.repartitionByRange("year", "_tr", "_tc").sortWithinPartitions("year", "_tr", "_tc", "row", "col")
    ordered.drop("_tr", "_tc").write.mode(mode).partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str, keep_header_when_empty: bool = False) -> bool:
    """Table with a header. An empty table leaves nothing unless the header
    is wanted; returns whether something was written. No byte-order mark. The
    table is computed once: its rows are counted while they are written."""
    spark, seen = df.sparkSession, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    if seen.get["n"]:
        return True
    if keep_header_when_empty:
        header = spark.createDataFrame([(",".join(df.columns),)], "value string")
        header.coalesce(1).write.mode("overwrite").text(path)
        return True
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return False


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_document(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def existing_years(spark: SparkSession, path: str) -> set[int]:
    """Years already written, read from the partition folders."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path) if s.isDirectory()]
    return {int(n.split("=")[1]) for n in names if n.startswith("year=")}


def finished_years(spark: SparkSession, path: str) -> dict[int, int | None]:
    """Years whose results are complete, with the batch that wrote them. A
    year is noted after its write has ended; a folder alone says nothing."""
    notes = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_finished")
    if not notes.getFileSystem(spark._jsc.hadoopConfiguration()).exists(notes):
        return {}
    return {r.year: r.batch for r in spark.read.schema("year int, batch long").parquet(f"{path}/_finished").collect()}


def write_missing_years(df: DataFrame, path: str, years: Sequence[int] | None = None, batch: int | None = None) -> None:
    """Resume: only years without a finished result are computed and written,
    each replacing just its own partition. The year filter is pushed into the
    plan of `df`, so finished years are not read again."""
    spark = df.sparkSession
    done = [y for y, by in finished_years(spark, path).items() if batch is None or by != batch]
    todo = df.where(~F.col("year").isin(*done)) if done else df
    if years is not None:
        left = [y for y in years if y not in done]
        if not left:
            return
        todo = todo.where(F.col("year").isin(*left))
    seen = Observation()
    todo = todo.observe(seen, F.collect_set("year").alias("years"))
    writer = todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year").parquet(path)
    rows = [(int(y), batch) for y in seen.get["years"]]
    if rows:
        spark.createDataFrame(rows, "year int, batch long").coalesce(1).write.mode("append").parquet(f"{path}/_finished")


def feature_json(df: DataFrame, geometry_type: str, coordinates: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row."""
    geometry = F.struct(F.lit(geometry_type).alias("type"), F.col(coordinates).alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, geometry_type: str, coordinates: str, properties: Sequence[str]) -> None:
    """Newline-delimited features, written in parallel."""
    feature_json(df, geometry_type, coordinates, properties).write.mode("overwrite").text(path)


def write_names(df: DataFrame, column: str, path: str) -> None:
    """Distinct sorted names, one per line."""
    df.select(F.col(column).cast("string").alias("value")).distinct().sort("value").write.mode("overwrite").text(path)


def qc_report(metadata: DataFrame, stats: DataFrame, indices: Sequence[str] = tuple(cfg.INDICES)) -> DataFrame:
    """Quality report text per year from raster metadata and band
    statistics; the first band stands for the pixel count."""
    order = F.create_map(*[x for i, b in enumerate(cfg.BANDS) for x in (F.lit(b), F.lit(i))])
    per_year = stats.groupBy("year").agg(
        F.min_by("count", F.element_at(order, F.col("band"))).alias("valid"), F.collect_set("band").alias("present"))
    m = metadata.join(per_year, "year").withColumn("total", F.col("width").cast("bigint") * F.col("height"))
    missing = F.col("total") - F.col("valid")
    pct = F.coalesce(100.0 * missing / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    def listed(names, has):
        return F.concat_ws(" ", *[F.when(has(x), F.lit(x)).otherwise(F.lit(f"no-{x}")) for x in names])
    lines = [
        F.format_string("year %d, grid %d x %d", F.col("year"), F.col("width"), F.col("height")),
        F.format_string("pixels %d = %d with data + %d without (%.3f %%)", F.col("total"), F.col("valid"), missing, pct),
        F.concat(F.lit("layers "), listed(cfg.BANDS, lambda b: F.array_contains("present", b)), F.lit(" "), listed(cfg.INDICES, lambda i: F.lit(i in indices))),
        F.format_string("%s, cells of %.2f by %.2f", F.col("crs"), F.col("resolution_x"), F.col("resolution_y")),
    ]
    return m.select("year", F.concat_ws("\n", *lines).alias("report"))


def provenance(spark: SparkSession, source: str, features: DataFrame, bounds: Sequence[float], name: str | None = None) -> DataFrame:
    """One row: where features came from, when, and how many."""
    return features.agg(F.count(F.lit(1)).alias("n_features")).select(
        F.lit(source).alias("source"), F.current_timestamp().alias("retrieved_utc"), "n_features",
        F.lit(name).cast("string").alias("name"), F.array(*[F.lit(float(b)) for b in bounds]).alias("bbox"),
    )
