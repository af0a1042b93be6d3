"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def literal_map(mapping: Mapping) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)


def lookup(mapping: Mapping, key: Column, default=None) -> Column:
    """Map-literal lookup with a default; unmatched keys give NULL without one."""
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def hash_key(seed, *keys: Column) -> Column:
    """Reproducible pseudo-random order: md5 of 'seed:key[:key...]'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_fraction(h: Column) -> Column:
    """First 32 bits of an md5 string as a number in [0, 1)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def is_close(a: Column, b: Column, rtol: float = 1e-3, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def null_if_not_finite(x: Column) -> Column:
    """NaN and infinities become NULL, the only missing marker used here."""
    x = x.cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def european_number(x: Column, digits: int = 2) -> Column:
    """1234567.891 -> '1 234 567,89'."""
    return F.translate(F.format_number(x, digits), ",.", " ,")
