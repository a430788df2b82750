"""Pivot and melt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numeric import NUMERIC_TYPES, lenient_double
from ..plans.layout import ROW_ID, quoted, with_row_id
from ..plans.running import exact_quantiles, running_sum
from ..plans.skew import equi_join
from .aggregate import aggregate_column, position
from .combine import common_type

PIVOT_FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "first", "last", "list")


def pivot_domain(df: DataFrame, column: str) -> list:
    """Sorted non-null values that become headers; Spark's ``pivotMaxValues`` bounds how many."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    col = F.col(quoted(column))
    found = df.select(col).where(col.isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column!r} has more than {limit} values; pivot_long, pivot_arrays and pivot_groups take any number")
    return sorted(r[0] for r in found)


def _check(index: Sequence[str], columns: str, values: str, func: str) -> None:
    if func not in PIVOT_FUNCTIONS:
        raise ValueError(f"unknown aggregate {func!r}")
    if not index or len({*index, columns, values}) != len(index) + 2:
        raise ValueError("index, columns and values must be different columns")


def pivot_table(df: DataFrame, index: Sequence[str] | str, columns: str, values: str, func: str = "first",
                domain: Sequence | None = None, order_by: str | Sequence[str] = ROW_ID) -> DataFrame:
    """One row per index, one column per value of ``columns``, cells aggregated from ``values``.

    Cells are aggregated first in long form (map-side combined, exact medians split over tasks) and only
    the finished cells are spread into columns, so neither a hot index nor a hot cell lands in one
    task. A ``list`` cell is one array by nature and must fit a Spark row; ``list_rows`` gives the same
    content without that limit.
    """
    index = [index] if isinstance(index, str) else list(index)
    _check(index, columns, values, func)
    domain = pivot_domain(df, columns) if domain is None else list(domain)
    cells = _cells(df, index, columns, values, func, order_by)
    return cells.groupBy(*[F.col(quoted(k)) for k in index]).pivot(columns, domain).agg(F.first("_cell"))


def _cells(df: DataFrame, index: Sequence[str], columns: str, values: str, func: str, order_by: str | Sequence[str]) -> DataFrame:
    """index, columns and the finished cell as `_cell`."""
    value = F.col(quoted(values))
    dtype = df.schema[values].dataType
    if func not in ("first", "last", "list", "count") and not isinstance(dtype, NUMERIC_TYPES):
        value = lenient_double(value, dtype)
    keys = [F.col(quoted(k)) for k in (*index, columns)]
    if func == "median":
        return exact_quantiles(df.select(*keys, value.alias("_value")), [*index, columns], "_value", {"_cell": 0.5})
    if func == "count":
        return df.groupBy(*keys).agg(F.count(value).alias("_cell"))
    if func == "list":
        ordered = F.array_sort(F.collect_list(F.struct(position(order_by).alias("at"), value.alias("v"))))
        return df.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias("_cell"))
    return df.groupBy(*keys).agg(aggregate_column(func, value, order_by).alias("_cell"))


def pivot_headers(df: DataFrame, columns: str) -> DataFrame:
    """rank (from 0) and header: the sorted non-null values of a column, however many. They are range-partitioned and numbered across partitions."""
    col = F.col(quoted(columns))
    return with_row_id(df.where(col.isNotNull()).select(col.alias("header")).distinct(), "header", name="rank").select("rank", "header")


def pivot_long(df: DataFrame, index: Sequence[str] | str, columns: str, values: str, func: str = "first", order_by: str | Sequence[str] = ROW_ID) -> DataFrame:
    """The filled cells of a pivot of any width: index, rank and header of the column (see `pivot_headers`), cell. Rows without a header
    (null) have no cell; empty cells have no row. The headers are joined on their value; a header that holds much of the cells is split."""
    index = [index] if isinstance(index, str) else list(index)
    _check(index, columns, values, func)
    cells = _cells(df, index, columns, values, func, order_by).where(F.col(quoted(columns)).isNotNull() & F.col("_cell").isNotNull())
    ranked = pivot_headers(df, columns).select("rank", F.col("header").alias("_header"))
    joined = equi_join(cells, ranked, [columns], ["_header"], unique_right=True)
    return joined.select(*[F.col(quoted(k)) for k in index], "rank", F.col("_header").alias("header"), F.col("_cell").alias("cell"))


def pivot_arrays(df: DataFrame, index: Sequence[str] | str, columns: str, values: str, func: str = "first", order_by: str | Sequence[str] = ROW_ID) -> DataFrame:
    """One row per index with `cells`, an array of (rank, value) sorted by the rank of the header. A row holds one index's cells, at most as many as there are headers."""
    index = [index] if isinstance(index, str) else list(index)
    long = pivot_long(df, index, columns, values, func, order_by)
    every = df.select(*[F.col(quoted(k)) for k in index]).distinct()
    packed = long.groupBy(*[F.col(quoted(k)) for k in index]).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("cell").alias("value")))).alias("cells"))
    names = [f"_p{i}" for i in range(len(index))]
    renamed = packed.select(*[F.col(quoted(k)).alias(n) for k, n in zip(index, names)], "cells")
    out = equi_join(every, renamed, index, names, "left", null_safe=True, unique_right=True)
    return out.select(*[F.col(quoted(k)) for k in index], F.coalesce("cells", F.array().cast(packed.schema["cells"].dataType)).alias("cells"))


def pivot_groups(df: DataFrame, index: Sequence[str] | str, columns: str, values: str, func: str = "first", order_by: str | Sequence[str] = ROW_ID, width: int = 1000) -> DataFrame:
    """The wide table cut into groups of `width` columns: index, group, cells, where place i of group g (both from 0) is the column of rank g * width + i, null where it is empty.
    Groups without a filled cell have no row, so a row is never longer than `width`."""
    index = [index] if isinstance(index, str) else list(index)
    if width < 1:
        raise ValueError("width must be at least 1")
    long = pivot_long(df, index, columns, values, func, order_by)
    placed = long.select(*[F.col(quoted(k)) for k in index], F.expr(f"rank div {width}").alias("group"), F.expr(f"cast(rank % {width} as int)").alias("at"), "cell")
    packed = placed.groupBy(*[F.col(quoted(k)) for k in index], "group").agg(F.map_from_entries(F.collect_list(F.struct("at", "cell"))).alias("_cells"))
    return packed.select(*[F.col(quoted(k)) for k in index], "group", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at("_cells", i)).alias("cells"))


def list_rows(df: DataFrame, index: Sequence[str] | str, columns: str, values: str,
              order_by: str | Sequence[str] = ROW_ID) -> DataFrame:
    """The content of ``list`` cells in long form: one row per element with its 1-based ``position``.

    For cells too large for one Spark row; positions of a hot cell are counted by many tasks.
    """
    keys = [*([index] if isinstance(index, str) else index), columns]
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    ones = df.select(*[F.col(quoted(c)) for c in dict.fromkeys([*keys, values, *order])], F.lit(1).alias("_one"))
    return (running_sum(ones, keys, order, "_one", "position")
            .select(*[F.col(quoted(k)) for k in keys], "position", F.col(quoted(values)).alias("value")))


def melt_table(df: DataFrame, id_columns: Sequence[str] = (), value_columns: Sequence[str] | None = None,
               variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Columns to rows (names in ``variable_name``); the row id is never melted.

    Mixed column types meet in a common type, which is text when nothing else fits.
    """
    ids = list(id_columns)
    chosen = list(value_columns) if value_columns is not None else [
        c for c in df.columns if c not in ids and c != ROW_ID]
    if not chosen:
        raise ValueError("no value columns to melt")
    dtype: T.DataType = df.schema[chosen[0]].dataType
    for c in chosen[1:]:
        dtype = common_type(dtype, df.schema[c].dataType)
    cast = df.select(*[F.col(quoted(c)) for c in ids],
                     *[F.col(quoted(c)).cast(dtype).alias(c) for c in chosen])
    return cast.unpivot([F.col(quoted(c)) for c in ids], [F.col(quoted(c)) for c in chosen], variable_name, value_name)
