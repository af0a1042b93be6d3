"""Median composites over arriving observations, late ones included.

The state is a table of counters: how often each digital number occurs for a
pixel and band. Counters of two batches add up, so an observation may arrive
in any batch and any order; each batch finishes only the pixels it touches.

Layout: `<path>/counters/batch=/year=` holds each batch's own counters,
`<path>/composite/batch=/year=` the pixels that the batch finished. A pixel's
composite is the row of its latest batch. A batch repeated after a failure
replaces its own two folders and reads only its predecessors' counters, so
the result does not depend on how often it ran.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom import config as cfg
from rasterloom.functions.spectral import reflectance

ROWS = ""  # the counter of observations, beside those of the bands
KEYS = "year int, row int, col int"


def counters(obs: DataFrame, bands: Sequence[str] = tuple(cfg.BANDS)) -> DataFrame:
    """(year, row, col, band, dn, n), combined before the shuffle. A missing
    number counts as an observation without a counter in its band."""
    seen = [F.struct(F.lit(b).alias("band"), F.col(b).cast("int").alias("dn")) for b in bands]
    every = F.struct(F.lit(ROWS).alias("band"), F.lit(0).alias("dn"))
    rows = obs.select("year", "row", "col", F.inline(F.array(*seen, every))).where("dn IS NOT NULL")
    return rows.groupBy("year", "row", "col", "band", "dn").agg(F.count(F.lit(1)).alias("n"))


def medians(counted: DataFrame, bands: Sequence[str] = tuple(cfg.BANDS), scale: bool = True) -> DataFrame:
    """The composite that the observations behind the counters give."""
    def middle(b):
        m = F.percentile(F.when(F.col("band") == b, F.col("dn")), 0.5, F.col("n"))
        return (reflectance(m) if scale else m).alias(b)

    n_obs = F.sum(F.when(F.col("band") == ROWS, F.col("n"))).alias("n_obs")
    return counted.groupBy("year", "row", "col").agg(*[middle(b) for b in bands], n_obs)


def _counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{KEYS}, band string, dn int, n long, batch long").parquet(f"{path}/counters")


def add_observations(
    batch: DataFrame, path: str, batch_id: int, bands: Sequence[str] = tuple(cfg.BANDS), scale: bool = True,
) -> None:
    """Add masked observations (year, row, col, bands) to the state and finish
    the pixels they touch. Earlier counters are read for the batch's years
    only; an empty batch changes nothing."""
    spark = batch.sparkSession
    own = f"batch={batch_id}"
    counters(batch, bands).write.mode("overwrite").partitionBy("year").parquet(f"{path}/counters/{own}")
    known = _counters(spark, path)
    touched = known.where(F.col("batch") == batch_id).select("year", "row", "col").distinct()
    years = [r.year for r in touched.select("year").distinct().collect()]
    known = known.where((F.col("batch") <= batch_id) & F.col("year").isin(*years)).join(touched, ["year", "row", "col"], "left_semi")
    medians(known, bands, scale).write.mode("overwrite").partitionBy("year").parquet(f"{path}/composite/{own}")


def current_composite(spark: SparkSession, path: str, bands: Sequence[str] = tuple(cfg.BANDS)) -> DataFrame:
    """Every pixel as its latest batch left it."""
    values = [*bands, "n_obs"]
    kinds = ", ".join(f"{b} double" for b in bands)
    rows = spark.read.schema(f"{KEYS}, {kinds}, n_obs long, batch long").parquet(f"{path}/composite")
    latest = rows.groupBy("year", "row", "col").agg(F.max_by(F.struct(*values), "batch").alias("_x"))
    return latest.select("year", "row", "col", "_x.*")


def extend_composite(
    stream: DataFrame, path: str, bands: Sequence[str] = tuple(cfg.BANDS), scale: bool = True,
    prepare: Callable[[DataFrame], DataFrame] = lambda d: d, checkpoint_path: str | None = None,
) -> StreamingQuery:
    """Keep the composite of a stream of observations. `prepare` selects and
    masks the rows of a batch."""
    writer = stream.writeStream.foreachBatch(lambda b, i: add_observations(prepare(b), path, i, bands, scale))
    writer = writer.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint_path or f"{path}/_progress").start()


def compact(spark: SparkSession, path: str, target: str, batch_id: int, bands: Sequence[str] = tuple(cfg.BANDS)) -> None:
    """Write the state up to a batch to a new folder as that one batch, with
    one row for each counter and pixel; later batches go on there."""
    known = _counters(spark, path).where(F.col("batch") <= batch_id)
    total = known.groupBy("year", "row", "col", "band", "dn").agg(F.sum("n").alias("n"))
    total.write.mode("overwrite").partitionBy("year").parquet(f"{target}/counters/batch={batch_id}")
    done = current_composite(spark, path, bands)
    done.write.mode("overwrite").partitionBy("year").parquet(f"{target}/composite/batch={batch_id}")
