"""Exact linear-interpolation quantiles that never order a crowded bucket.

Spark's own exact percentile keeps every distinct value of a group in one
buffer. That is right for digital numbers (at most 10 001 of them) and wrong
for continuous indices over billions of pixels. Here a fine histogram finds
the bucket each rank falls into. A bucket that still holds many different
values (an outlier can press all others into one) gets a histogram of its own,
over its own range, as often as needed; only small buckets are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.columns import null_if_not_finite
from rasterloom.session import broadcast_if_small, checkpoint, sized

BUCKETS = 65536
LIMIT = 1_000_000  # rows that may be ordered together


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    bounds: tuple[float, float] | None = None,
    buckets: int = BUCKETS,
    limit: int = LIMIT,
) -> DataFrame:
    """Long table (by..., p, q). `by` must be low-cardinality (years,
    features, classes). Pass `bounds` when the value range is known, such as
    (-1, 1) for indices, to save the pass that finds it.

    Passes: range (optional), histogram, and the few hit buckets. Shuffled
    data is the histogram and those buckets, not the values themselves. At
    most `limit` rows of a group are ordered together."""
    by = list(by)
    v = df.select(*by, null_if_not_finite(F.col(value)).alias("_v")).where("_v is not null")
    v = checkpoint(v)  # the input is computed once, whatever the number of passes
    found, _ = _level(v, by, probs, None, bounds, buckets, limit)
    both = found.groupBy(*by, "p").agg(*[F.max(F.when(F.col("_side") == i, F.col("_q"))).alias(f"_q{i}") for i in (0, 1)], F.max("_frac").alias("_frac"))
    return both.select(*by, "p", (F.col("_q0") + (F.col("_q1") - F.col("_q0")) * F.col("_frac")).alias("q"))


def _level(v: DataFrame, keys: list[str], probs, ranks: DataFrame | None, bounds, buckets: int, limit: int, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Values at the wanted ranks of each group of `keys`: (keys..., p, _side,
    _frac, _q). Ranks are (keys..., p, _side, _rank, _frac), or follow from
    `probs` and the group sizes."""
    if bounds is None:
        span = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        v = _join(v, broadcast_if_small(span), keys)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    b = f"_b{depth}"
    # halves first, so that the widest range does not overflow
    share = F.coalesce((F.col("_v") / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0)), F.lit(0.0))
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(share * buckets)))
    v = v.select(*keys, "_v", bucket.cast("int").alias(b))
    hist = v.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    hits, hint = sized(_hits(hist, keys, b, probs, ranks))
    same = F.col("_least") == F.col("_most")
    out = hits.where(same).select(*keys, "p", "_side", "_frac", F.col("_least").alias("_q"))

    small = hits.where(~same & (F.col("_n") <= limit))
    cells = _join(v, hint(small.select(*keys, b).distinct()), [*keys, b]).groupBy(*keys, b, "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, b).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_end", F.sum("_c").over(order))
    placed = _join(cells, hint(small), [*keys, b]).withColumn("_last", F.col("_before") + F.col("_end"))
    here = (F.col("_last") - F.col("_c") <= F.col("_rank")) & (F.col("_last") > F.col("_rank"))
    out = out.unionByName(placed.where(here).select(*keys, "p", "_side", "_frac", F.col("_v").alias("_q")))

    large = hits.where(~same & (F.col("_n") > limit))
    if not large.isEmpty():
        inside = _join(v, hint(large.select(*keys, b).distinct()), [*keys, b])
        left = large.select(*keys, b, "p", "_side", (F.col("_rank") - F.col("_before")).alias("_rank"), "_frac")
        deeper, _ = _level(inside, [*keys, b], probs, left, None, buckets, limit, depth + 1)
        out = out.unionByName(deeper.select(*keys, "p", "_side", "_frac", "_q"))
    return out, hits


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return left.join(right, keys)
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _hits(hist: DataFrame, keys: list[str], b: str, probs: Sequence[float], ranks: DataFrame | None) -> DataFrame:
    """Buckets that hold a wanted rank, with the number of values before
    them. At most `buckets` rows per group enter the window."""
    group = Window.partitionBy(*(keys or [F.lit(1)]))
    running = group.orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumns({"_after": F.sum("_n").over(running), "_total": F.sum("_n").over(group)}).withColumn("_before", F.col("_after") - F.col("_n"))
    if ranks is None:
        cum = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        exact = F.col("p") * (F.col("_total") - 1)
        sides = F.array(*[F.struct(F.lit(i).alias("_side"), f(exact).alias("_rank")) for i, f in ((0, F.floor), (1, F.ceil))])
        cum = cum.withColumn("_frac", exact - F.floor(exact)).withColumn("_s", F.explode(sides)).select("*", "_s.*")
    else:
        cum = cum.join(ranks, keys)
    held = (F.col("_before") <= F.col("_rank")) & (F.col("_after") > F.col("_rank"))
    return cum.where(held).select(*keys, b, "p", "_side", "_rank", "_frac", "_before", "_n", "_least", "_most")


def quantile_columns(long: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Pivot the long result into one column per quantile."""
    picks = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in names.items()]
    return long.groupBy(*by).agg(*picks)


def exact_thresholds(df: DataFrame, by: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    return exact_quantiles(df, by, value, [p]).select(*by, F.col("q").alias(name))
