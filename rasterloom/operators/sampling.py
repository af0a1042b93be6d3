"""Reproducible sampling. Every random choice orders rows by the md5 of
'seed:key', so samples are the same on any cluster and mergeable.

The k smallest hashes of a group are found without ordering the group: a
65 536-bin histogram of the hash prefix gives the bin where the k-th row
falls; lower bins are taken whole and only that one bin is ordered. A class
holding most of the raster therefore never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.columns import hash_fraction, hash_key
from rasterloom.session import broadcast_if_small, checkpoint


def choose_smallest(df: DataFrame, by: Sequence[str], h: str, k: Column | int, only: bool = True) -> DataFrame:
    """Mark (`only=False`) or keep the k rows with the smallest hash in each
    group; `k` may be an expression over the group size `n_group`. The input
    is written once, so it is computed once."""
    by = list(by)
    k = k if isinstance(k, Column) else F.lit(k)
    binned = checkpoint(df.withColumn("_b", F.conv(F.substring(h, 1, 4), 16, 10).cast("int")))
    group = Window.partitionBy(*by)
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (
        binned.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_after": F.sum("_n").over(running), "n_group": F.sum("_n").over(group)})
        .withColumn("_k", k.cast("bigint"))
    )
    below = F.col("_after") <= F.col("_k")
    cut = hist.groupBy(*by).agg(
        F.coalesce(F.min(F.when(~below, F.col("_b"))), F.lit(65536)).alias("_cut"),
        (F.max("_k") - F.coalesce(F.max(F.when(below, F.col("_after"))), F.lit(0))).alias("_need"),
    )
    joined = binned.join(broadcast_if_small(cut), by)
    # only the bin of the cut is ordered; all other rows pass as they are
    in_bin = Window.partitionBy(*by, "_b").orderBy(h)
    at_cut = joined.where(F.col("_b") == F.col("_cut")).withColumn("_rn", F.row_number().over(in_bin))
    at_cut = at_cut.withColumn("chosen", F.col("_rn") <= F.col("_need")).drop("_rn")
    others = joined.where(F.col("_b") != F.col("_cut")).withColumn("chosen", F.col("_b") < F.col("_cut"))
    marked = others.unionByName(at_cut).drop("_b", "_cut", "_need")
    return marked.where("chosen").drop("chosen") if only else marked


def _hashed(df: DataFrame, seed, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_h", hash_key(seed, *[F.col(k) for k in keys]))


def sample_pixels(
    df: DataFrame, k: int = cfg.SAMPLES_PER_YEAR, seed: int = cfg.SEED,
    by: Sequence[str] = ("year",), keys: Sequence[str] = ("row", "col"),
) -> DataFrame:
    """Uniform sample of up to k valid pixels per year; the seed of a year
    is seed + year."""
    yearly = F.concat_ws(":", (F.lit(seed) + F.col("year")).cast("string"), *[F.col(c).cast("string") for c in keys])
    return choose_smallest(df.withColumn("_h", F.md5(yearly)), by, "_h", k).drop("_h")


def stratified_sample(
    df: DataFrame, per_class: int = cfg.SAMPLES_PER_CLASS, seed: int = cfg.SEED,
    label: str = "class", keys: Sequence[str] = ("row", "col"),
    classes: Sequence[int] = (0, 1, 2, 3), features: Sequence[str] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Up to n random rows of every listed class (within each group of `by`),
    rows with NULLs dropped."""
    usable = df.dropna(subset=list(features) if features else None)
    usable = usable.where(F.col(label).isin(*classes))
    return choose_smallest(_hashed(usable, seed, keys), [*by, label], "_h", per_class).drop("_h")


def cleaned_sample(
    df: DataFrame, per_class: int = cfg.SAMPLES_PER_CLASS, oversample: int = cfg.WATER_OVERSAMPLE,
    ndwi_min: float = cfg.WATER_NDWI_MIN, seed: int = cfg.SEED, keys=("row", "col"),
    features=None, by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Water is oversampled, kept only where NDWI exceeds the limit, then
    thinned at random; the other classes are sampled as usual. Returns the
    union and one row of cleaning statistics for each group of `by`."""
    others = stratified_sample(df, per_class, seed, keys=keys, classes=(1, 2, 3), features=features, by=by)
    candidates = stratified_sample(df, oversample, seed, keys=keys, classes=(0,), features=features, by=by)
    passed = candidates.where(F.col("NDWI") > ndwi_min)
    # the candidates are at most `oversample` rows, one window is enough
    second = _hashed(passed, f"{seed}:sort", keys)
    rank = F.row_number().over(Window.partitionBy(*by, "class").orderBy("_h"))
    water = second.withColumn("_rn", rank).where(F.col("_rn") <= per_class).drop("_rn", "_h")
    ok = F.col("NDWI") > ndwi_min
    stats = candidates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("water_candidates"),
        F.count_if(ok).alias("water_passed_ndwi_filter"),
        F.least(F.count_if(ok), F.lit(per_class)).alias("water_final_used"),
        (100.0 * (1.0 - F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0)))).alias("water_removed_pct"),
        F.lit(float(ndwi_min)).alias("ndwi_threshold"),
    )
    return water.unionByName(others), stats


def sample_region(df: DataFrame, inside: Column, n: int = cfg.HAND_POINTS, seed: int = cfg.SEED, keys=("row", "col")) -> DataFrame:
    """n uniform random pixels of a region."""
    region = _hashed(df.where(inside), seed, keys).withColumn("_one", F.lit(1))
    return choose_smallest(region, ["_one"], "_h", n).drop("_one", "_h")


def with_uniform(df: DataFrame, seed: int = cfg.SEED, keys=("row", "col"), name: str = "u") -> DataFrame:
    return df.withColumn(name, hash_fraction(hash_key(seed, *[F.col(k) for k in keys])))


def train_test_split(df: DataFrame, seed: int = cfg.SEED, keys=("row", "col"), fraction: float = cfg.TRAIN_FRACTION):
    """Split by a uniform column: below the fraction trains, the rest tests."""
    u = with_uniform(df, seed, keys, "_u")
    return (
        u.where(F.col("_u") < fraction).drop("_u"),
        u.where(F.col("_u") >= fraction).drop("_u"),
    )


def exact_split(
    df: DataFrame, seed: int = cfg.SEED, keys=("row", "col"), label: str = "class",
    fraction: float = cfg.TRAIN_FRACTION, by: Sequence[str] = (),
) -> DataFrame:
    """Add `is_train`: exactly round-half-even(fraction * n) rows per class
    (within each group of `by`)."""
    quota = F.bround(F.lit(fraction) * F.col("n_group"), 0)
    hashed = _hashed(df, seed, keys)
    return choose_smallest(hashed, [*by, label], "_h", quota, only=False).withColumnRenamed("chosen", "is_train").drop("_h")


def check_class_sizes(df: DataFrame, label: str = "class", minimum: int = cfg.MIN_SAMPLES_PER_CLASS) -> None:
    """Raise unless every class has the minimum number of rows (4 rows read)."""
    small = df.groupBy(label).count().where(F.col("count") < minimum).take(1)
    if small:
        raise ValueError(f"class {small[0][0]} has only {small[0][1]} valid samples")


def qc_points(samples: DataFrame, n: int = 20, seed: int = cfg.SEED, keys=("row", "col"), label: str = "class", by: Sequence[str] = ()) -> DataFrame:
    """A few random sample points of each class for visual checks."""
    return choose_smallest(_hashed(samples, seed, keys), [*by, label], "_h", n).drop("_h")
