"""Column expressions for reflectance and spectral indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.functions.columns import require_columns


def safe_divide(num: Column, den: Column, fill: float | None = None) -> Column:
    """num / den, with `fill` (NULL by default) where the denominator is 0."""
    ratio = num / F.nullif(den, F.lit(0.0))
    if fill is None:
        return ratio
    return F.when(den == 0, F.lit(float(fill))).otherwise(ratio)


def normalized_difference(a: Column, b: Column, mode: str = "null") -> Column:
    """(a - b) / (a + b). mode 'null' masks a zero denominator, mode 'clamp'
    bounds the denominator from below by 1e-6."""
    a, b = a.cast("double"), b.cast("double")
    if mode == "clamp":
        return (a - b) / F.greatest(a + b, F.lit(1e-6))
    return safe_divide(a - b, a + b)


def ndvi(nir, red, mode="null"):
    return normalized_difference(nir, red, mode)


def ndbi(swir, nir, mode="null"):
    return normalized_difference(swir, nir, mode)


def ndwi(green, nir, mode="null"):
    return normalized_difference(green, nir, mode)


def add_indices(df: DataFrame, mode: str = "null") -> DataFrame:
    require_columns(df, ["B3", "B4", "B8", "B11"])
    c = F.col
    return df.withColumns({
        "NDVI": ndvi(c("B8"), c("B4"), mode),
        "NDBI": ndbi(c("B11"), c("B8"), mode),
        "NDWI": ndwi(c("B3"), c("B8"), mode),
    })


def reflectance(x: Column) -> Column:
    return x / F.lit(float(cfg.REFLECTANCE_SCALE))


def landsat_reflectance(df: DataFrame, pattern: str = "^sr_b.$") -> DataFrame:
    """Apply the Collection 2 Level 2 gain and offset to every optical band
    whose name matches the pattern; other columns pass through."""
    import re

    matched = [c for c in df.columns if re.match(pattern, c)]
    scaled = {
        c: F.col(c) * F.lit(cfg.LANDSAT_GAIN) + F.lit(cfg.LANDSAT_OFFSET) for c in matched
    }
    return df.withColumns(scaled) if scaled else df


def qa_clear(qa: Column, bits=tuple(cfg.QA_CLOUD_BITS)) -> Column:
    """True where none of the given QA bits is set."""
    mask = sum(1 << b for b in bits)
    return qa.bitwiseAND(F.lit(mask)) == 0


def scl_clear(scl: Column, codes=tuple(cfg.SCL_CLOUD_CODES)) -> Column:
    return ~scl.isin(*codes)
