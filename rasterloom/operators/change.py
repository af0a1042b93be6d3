"""Class maps, areas and change between dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.columns import lookup

CLASSES = sorted(cfg.CLASS_NAMES)


def remap_landcover(code: Column, scheme: str = "server") -> Column:
    mapping, default = cfg.LANDCOVER_SCHEMES[scheme]
    return lookup(mapping, code, default)


def class_name(cls: Column, names=cfg.CLASS_NAMES) -> Column:
    return lookup(names, cls)


def with_class_name(df: DataFrame, label: str = "class") -> DataFrame:
    """Names for integer classes; string classes are their own name."""
    if df.schema[label].dataType.typeName() == "string":
        return df.withColumn("class_name", F.col(label))
    return df.withColumn("class_name", class_name(F.col(label)))


def class_histogram(df: DataFrame, label: str = "class", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def class_area_table(classified: DataFrame, pixel_ha: float = cfg.PIXEL_AREA_HA, classes=CLASSES) -> DataFrame:
    """Pixels, hectares and percent for every (year, class), zeros included.
    Percentages refer to all coded pixels, those of other codes too. The pixel table is reduced to one row per year before the class frame is
    added."""
    counted = classified.groupBy("year").agg(*[
        F.count_if(F.col("class") == c).alias(f"_{c}") for c in classes
    ], F.count("class").alias("total_pixels"))
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_{c}").alias("n")) for c in classes])
    long = counted.select("year", "total_pixels", F.explode(cells).alias("c"))
    return long.select(
        "year", F.col("c.class").alias("class"), F.col("c.n").alias("n"), "total_pixels",
        (F.col("c.n") * F.lit(pixel_ha)).alias("area_ha"),
        F.coalesce(100.0 * F.col("c.n") / F.nullif(F.col("total_pixels"), F.lit(0)), F.lit(0.0)).alias("area_pct"),
    )


def area_by_class(classified: DataFrame, area: str, by=("year",)) -> DataFrame:
    """Summed true pixel area per class."""
    return classified.groupBy(*by, "class").agg(F.sum(area).alias("area_ha"))


def area_of_class(classified: DataFrame, area: str, cls: int, by=("year",)) -> DataFrame:
    hit = F.when(F.col("class") == cls, F.col(area)).otherwise(0.0)
    return classified.groupBy(*by).agg(F.sum(hit).alias("area_ha"))


def encode_pair(a: Column, b: Column) -> Column:
    return a * 10 + b


def decode_pair(code: Column) -> tuple[Column, Column]:
    return F.floor(code / 10).cast("int"), (code % 10).cast("int")


def transition_matrix(
    before: DataFrame, after: DataFrame, area: Column | None = None,
    keys: Sequence[str] = ("row", "col"), classes=CLASSES,
) -> DataFrame:
    """Long (from_class, to_class, ha) with all class pairs. One co-located
    equi-join on the pixel, then a map-side aggregate over at most 16 codes."""
    area = F.lit(cfg.PIXEL_AREA_HA) if area is None else area
    a = before.select(*keys, F.col("class").alias("c0"))
    b = after.withColumn("_ha", area).select(*keys, F.col("class").alias("c1"), "_ha")
    code = encode_pair(F.col("c0"), F.col("c1")).alias("code")
    sums = a.join(b, list(keys)).groupBy(code).agg(F.sum("_ha").alias("ha"))
    codes = [i * 10 + j for i in classes for j in classes]
    filled = sums.agg(*[F.sum(F.when(F.col("code") == c, F.col("ha"))).alias(f"_{c}") for c in codes])
    cells = F.array(*[
        F.struct(F.lit(c).alias("code"), F.coalesce(F.col(f"_{c}"), F.lit(0.0)).alias("ha")) for c in codes
    ])
    long = filled.select(F.explode(cells).alias("x")).select("x.*")
    i, j = decode_pair(F.col("code"))
    return long.select(i.alias("from_class"), j.alias("to_class"), "ha")


def transition_summary(matrix: DataFrame) -> DataFrame:
    same = F.col("from_class") == F.col("to_class")
    return matrix.agg(
        F.sum("ha").alias("total_ha"),
        F.sum(F.when(same, F.col("ha")).otherwise(0.0)).alias("unchanged_ha"),
        F.sum(F.when(~same, F.col("ha")).otherwise(0.0)).alias("changed_ha"),
    ).withColumn(
        "changed_pct", F.coalesce(100.0 * F.col("changed_ha") / F.nullif(F.col("total_ha"), F.lit(0.0)), F.lit(0.0))
    )


def transition_flows(matrix: DataFrame, min_ha: float = 0.0, top: int | None = None) -> DataFrame:
    """Off-diagonal flows of at least `min_ha`, largest first."""
    w = Window.partitionBy(F.lit(1))  # the matrix has 16 rows
    named = matrix.withColumn("total", F.sum("ha").over(w)).where(
        (F.col("from_class") != F.col("to_class")) & (F.col("ha") >= min_ha)
    )
    label = F.concat(class_name(F.col("from_class")), F.lit(" → "), class_name(F.col("to_class")))
    flows = named.select(label.alias("flow"), "ha", (100.0 * F.col("ha") / F.nullif(F.col("total"), F.lit(0.0))).alias("pct"))
    flows = flows.orderBy(F.desc("ha"), "flow")
    return flows if top is None else flows.limit(top)


def transition_pivot(matrix: DataFrame, classes=CLASSES) -> DataFrame:
    return matrix.groupBy("from_class").pivot("to_class", list(classes)).agg(F.first("ha"))


def transition_totals(matrix: DataFrame) -> DataFrame:
    """Cell, row, column and grand totals; -1 marks a total."""
    return (
        matrix.cube("from_class", "to_class").agg(F.sum("ha").alias("ha"))
        .select(
            F.coalesce("from_class", F.lit(-1)).alias("from_class"),
            F.coalesce("to_class", F.lit(-1)).alias("to_class"), "ha",
        )
    )


def gain_loss(matrix: DataFrame, cls: int = cfg.BUILT_UP) -> DataFrame:
    """Gain, loss and net of one class, and the share of its first-date area
    that changed label."""
    f, t, ha = F.col("from_class") == cls, F.col("to_class") == cls, F.col("ha")
    def total(cond):
        return F.sum(F.when(cond, ha).otherwise(0.0))
    sums = matrix.agg(total(~f & t).alias("gain_ha"), total(f & ~t).alias("loss_ha"), total(f).alias("before_ha"))
    return sums.withColumns({
        "net_ha": F.col("gain_ha") - F.col("loss_ha"),
        "unstable_pct": 100.0 * F.col("loss_ha") / F.nullif(F.col("before_ha"), F.lit(0.0)),
    })


def change_significance(area: DataFrame, margin_ha: float | Column) -> DataFrame:
    """Change between consecutive years against the error of a difference,
    margin * sqrt(2). One row per year, so one window partition is fine."""
    margin = margin_ha if isinstance(margin_ha, Column) else F.lit(float(margin_ha))
    w = Window.partitionBy(F.lit(1)).orderBy("year")
    steps = area.select(
        "year", F.lag("year").over(w).alias("prev_year"),
        (F.col("ha") - F.lag("ha").over(w)).alias("delta_ha"),
        (margin * F.sqrt(F.lit(2.0))).alias("margin_diff_ha"),
    ).where(F.col("prev_year").isNotNull())
    ratio = F.coalesce(F.abs("delta_ha") / F.nullif(F.col("margin_diff_ha"), F.lit(0.0)), F.lit(float("inf")))
    return steps.select(
        F.concat(F.col("prev_year").cast("string"), F.lit(" → "), F.col("year").cast("string")).alias("period"),
        "delta_ha", "margin_diff_ha", ratio.alias("ratio"),
        (F.abs("delta_ha") > F.col("margin_diff_ha")).alias("significant"),
    )
