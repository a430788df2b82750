"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def list_get(col: Column | str, index: int) -> Column:
    """Element at a 0-based index, negative from the end; null when out of range."""
    col = F.col(col) if isinstance(col, str) else col
    return F.get(col, F.lit(index)) if index >= 0 else F.get(col, F.size(col) + F.lit(index))


def where_values(col: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(col, keep)


def first_n(col: Column, n: int) -> Column:
    return F.slice(col, 1, n)


def last_n(col: Column, n: int) -> Column:
    """Last ``n`` elements, or all of a shorter array."""
    return F.slice(col, F.greatest(F.size(col) - n, F.lit(0)) + 1, F.lit(n))


def sorted_values(col: Column) -> Column:
    return F.array_sort(col)


def distinct_values(col: Column) -> Column:
    return F.array_distinct(col)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it.

    It is the start of a fold over nothing: unlike the elements that ``transform`` makes, that is not copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda so_far, _: so_far, use)


def value_counts_map(col: Column) -> Column:
    """Array of ``{value, count}`` over the distinct elements of an array, in order of first appearance.

    Equal elements stand together after a sort with their places, so that long arrays take n log n steps. The sort is `sort_array`, as the one of
    `array_sort` works out an expression for every comparison; runs are numbers until the last step, so that values are not copied on the way.
    """
    def counts(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, at: at), lambda at: (at == 0) | ~F.get(s, at - 1).value.eqNullSafe(F.get(s, at).value))
        runs = _bound(starts, lambda r: F.transform(r, lambda at, k: F.struct(
            F.get(s, at).i.alias("i"), at.alias("at"), (F.coalesce(F.get(r, k + 1), F.size(s)) - at).cast("bigint").alias("count"))))
        return F.transform(F.sort_array(runs), lambda e: F.struct(F.get(s, e["at"]).value.alias("value"), e["count"].alias("count")))

    return _bound(F.sort_array(F.transform(col, lambda v, i: F.struct(v.alias("value"), i.alias("i")))), counts)
