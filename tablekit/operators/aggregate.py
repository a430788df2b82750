"""Grouped summaries behind bars and pies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import lenient_double
from ..plans.layout import ROW_ID, quoted
from ..plans.running import exact_quantiles
from ..plans.skew import equi_join

FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "first", "last")


def position(order_by: str | Sequence[str]) -> Column:
    """The value that orders rows for first/last."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return F.struct(*[F.col(quoted(k)) for k in keys]) if len(keys) > 1 else F.col(quoted(keys[0]))


def aggregate_column(func: str, value: Column, order_by: str | Sequence[str]) -> Column:
    """Aggregate expression by name; every one combines on the map side in bounded memory."""
    made = {
        "sum": lambda: F.sum(value), "mean": lambda: F.avg(value), "min": lambda: F.min(value),
        "max": lambda: F.max(value), "count": lambda: F.count("*"),
        "first": lambda: F.min_by(value, position(order_by)), "last": lambda: F.max_by(value, position(order_by)),
    }
    if func not in made:
        raise ValueError(f"unknown aggregate {func!r}")
    return made[func]()


def group_summary(df: DataFrame, keys: Sequence[str], func: str = "count", value: str | None = None,
                  carry: Sequence[str] = (), order_by: str | Sequence[str] = ROW_ID, out: str = "value",
                  approx: bool = False) -> DataFrame:
    """One aggregate of one value column per group, sorted by the first key.

    The value is read leniently as a number unless rows are counted; without a value column rows are
    counted. ``carry`` columns travel along by their first value in table order. The median is exact
    unless ``approx`` is set; see ``exact_quantiles`` for how it avoids holding a group in one task.

    Carried cells are fetched late: the summary finds the smallest first key of ``order_by`` per group, then only the rows that have it are read in
    full. Rows without that key come after all others.
    """
    if func not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {func!r}")
    keys = list(keys)
    if value is None:
        func = "count"
    number = None if func == "count" else lenient_double(F.col(quoted(value)), df.schema[value].dataType)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    first = [F.min(F.col(quoted(order[0]))).alias("_first")] if carry else []
    columns = [F.col(quoted(k)) for k in keys]
    if func == "median" and not approx:
        result = exact_quantiles(df.select(*columns, number.alias("_value")), keys, "_value", {out: 0.5})
        spots = df.groupBy(*columns).agg(*first) if carry else None
    else:
        agg = (F.percentile_approx(number, 0.5, 10_000) if func == "median"
               else aggregate_column(func, number, order_by))
        result = spots = df.groupBy(*columns).agg(agg.alias(out), *first)
    if carry:
        names = [f"_g{i}" for i in range(len(keys))]
        found = _first_rows(df, spots, keys, carry, order, names)
        same = [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names)] or F.lit(True)
        result = result.drop("_first").join(found, same, "left").drop(*names)
    # The further keys make the sort key unique, so a first key shared by many groups still spreads.
    return result.orderBy(*[F.col(quoted(k)).asc_nulls_first() for k in keys])


def _first_rows(df: DataFrame, spots: DataFrame, keys: Sequence[str], carry: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The carried cells of the first row of each group, its keys as `names`. `spots` has the groups and their smallest first key, `_first`.

    Hot groups are split by the join, and of rows that share the first key each input partition sends one per group.
    """
    places = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[F.col(quoted(k)).alias(f"_r{i}") for i, k in enumerate(keys)], *[F.col(quoted(o)).alias(p) for o, p in zip(order, places)],
                     *[F.col(quoted(c)).alias(c) for c in carry if c not in keys])
    spots = spots.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], "_first")
    hits = equi_join(rows, spots, [*[f"_r{i}" for i in range(len(keys))], places[0]], [*names, "_first"], null_safe=True, unique_right=True)
    window = Window.partitionBy(*names).orderBy(*[F.col(p).asc_nulls_first() for p in places])
    first = hits.withColumn("_rank", F.row_number().over(window)).where("_rank = 1")
    return first.select(*names, *[F.col(quoted(c)) for c in carry if c not in keys])


def count_by(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    return group_summary(df, [column], "count", out=out)


def sum_by(df: DataFrame, column: str, value: str, out: str = "sum") -> DataFrame:
    return group_summary(df, [column], "sum", value, out=out)
