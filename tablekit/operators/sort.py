"""Sorting with nulls first in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.layout import ROW_ID, quoted, sorted_by


def sort_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort by one column; rows with equal values follow the row id where there is one."""
    key = F.col(quoted(column))
    return sorted_by(df, [key.asc_nulls_first() if ascending else key.desc_nulls_first()])


def top_k(df: DataFrame, column: str, k: int, then: str = ROW_ID) -> DataFrame:
    """The ``k`` largest rows; each partition keeps only its own best ``k``."""
    return df.orderBy(F.col(quoted(column)).desc_nulls_last(), F.col(quoted(then))).limit(k)
