"""Numeric helpers that never raise on bad input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Decimal numbers as other engines read them. Java alone would also take type suffixes and hexadecimal
# floats; and a failed cast costs far more than this test.
_NUMBER = r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)\s*$"


def lenient_double(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """Value as double, null where it is not a number.

    Numeric columns take the plain cast, which keeps comparisons on them eligible for scan pushdown.
    """
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.DoubleType):
        return col
    if isinstance(dtype, (*NUMERIC_TYPES, T.BooleanType)):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(_NUMBER), col.try_cast("double"))
    if dtype is None:
        return col.try_cast("double")
    return F.lit(None).cast("double")


def is_finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def is_infinite(col: Column) -> Column:
    return F.abs(col) == F.lit(float("inf"))


def safe_divide(a: Column, b: Column) -> Column:
    """Null instead of an error on division by zero."""
    return F.try_divide(a, b)


def safe_mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def xor(a: Column, b: Column) -> Column:
    return a != b


def quantile_disc(col: str, q: float) -> Column:
    """Nearest-rank quantile (``percentile`` interpolates)."""
    return F.expr(f"percentile_disc({q}) within group (order by `{col}`)")
