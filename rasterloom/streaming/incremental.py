"""Incremental work on arriving tables: a mergeable reservoir sample and
yearly results that are extended as new years arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom import config as cfg, sinks
from rasterloom.operators.sampling import sample_pixels


def update_sample(
    stream: DataFrame, state_path: str, k: int = cfg.SAMPLES_PER_YEAR, seed: int = cfg.SEED,
    checkpoint_path: str | None = None,
) -> StreamingQuery:
    """Keep a uniform sample of up to k pixels per year over a stream of
    pixel rows. The sample is the k smallest hashes, so the sample of the old
    sample and a new batch is the sample of everything seen. Each batch
    writes a new version named by its id; a repeated batch after a failure
    rewrites the same version from the same predecessor."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = current_sample(spark, state_path, before=batch_id)
        both = batch if seen is None else batch.unionByName(seen.select(*batch.columns))
        sample_pixels(both, k, seed).write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")

    writer = stream.writeStream.foreachBatch(merge).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint_path or f"{state_path}/_progress").start()


def current_sample(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """Latest version of the sample, or the latest before a batch."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path)]
    versions = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    versions = [v for v in versions if before is None or v < before]
    if not versions:
        return None
    return spark.read.parquet(f"{state_path}/version={versions[-1]}")


def extend_years(
    stream: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint_path: str,
    years: Sequence[int] | None = None,
) -> StreamingQuery:
    """Run a yearly computation on each arriving batch of whole years and add
    the years that have no result yet. Rows of a year that an earlier batch
    has finished cannot be merged into the result of any computation, so they
    stop the stream (composites take them: `composites.extend_composite`); a
    batch that is repeated after a failure writes its own years again."""
    def add(batch: DataFrame, batch_id: int) -> None:
        finished = sinks.finished_years(batch.sparkSession, out)
        late = batch.where(F.col("year").isin(*[y for y, by in finished.items() if by != batch_id])) if finished else batch.limit(0)
        found = late.select("year").take(1)
        if found:
            raise ValueError(f"rows of the finished year {found[0][0]} arrived late; remove its result to compute it again")
        sinks.write_missing_years(compute(batch), out, years, batch_id)

    writer = stream.writeStream.foreachBatch(add).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint_path).start()
