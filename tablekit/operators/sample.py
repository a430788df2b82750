"""Repeatable samples of an exact size, and the size that represents a column."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import NUMERIC_TYPES
from ..plans.layout import ROW_ID, hashable, quoted
from ..plans.sizing import rows_per_task

DEFAULT_SIZE = 10_000
DEFAULT_SEED = 42
# Rows among which the last one of a sample is found by sorting; where more share the leading bits of a draw, further bits are counted.
_SORTED_ROWS = 100_000
_DIGIT_BITS = 16


def _draw_limit(draws: DataFrame, n: int, ties: list[str]) -> tuple | None:
    """The n-th smallest row of (`_draw`, ties); None if there are no more than n rows.

    Draws are counted by their leading 16 bits, then, within the digit that holds the n-th, by the next ones, until few enough are left
    to be sorted. A pass brings at most 2^16 counts to the driver.
    """
    low, shift = -(1 << 63), 64
    while True:
        shift -= _DIGIT_BITS
        inside = draws if shift == 64 - _DIGIT_BITS else draws.where(F.col("_draw").between(low, low + (1 << (shift + _DIGIT_BITS)) - 1))
        digits = inside.groupBy(F.shiftright("_draw", shift).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
        if shift == 64 - _DIGIT_BITS and sum(r["n"] for r in digits) <= n:
            return None
        for r in digits:
            if n <= r["n"]:
                low, held = r["d"] << shift, r["n"]
                break
            n -= r["n"]
        if held <= _SORTED_ROWS or not shift:
            some = draws.where(F.col("_draw").between(low, low + (1 << shift) - 1)).select("_draw", *ties)
            return tuple(some.orderBy("_draw", *ties).limit(n).collect()[-1])


def _up_to(limit: tuple, ties: list[str]) -> Column:
    """Whether (`_draw`, ties) does not come after the limit."""
    test = F.lit(True)
    for name, value in reversed([*zip(["_draw", *ties], limit)]):
        test = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
    return test


def sample_rows(df: DataFrame, n: int = DEFAULT_SIZE, seed: int = DEFAULT_SEED, key: str = ROW_ID) -> DataFrame:
    """Exactly ``min(n, rows)`` rows chosen at random by ``seed``; all rows when there are no more.

    Rows are drawn by a hash of their unique, non-null ``key``, so the choice does not depend on partitioning. Counting passes over the key column find the draw of
    the last row, and one filter takes all rows up to it, for any ``n``. Without the key column, rows are drawn by their content: equal rows
    are counted, each copy has a draw of its own, and the chosen contents are looked up in the table.
    """
    if key not in df.columns:
        return _sample_by_content(df, n, seed)
    if n < 1:
        return df.limit(0)
    drawn = df.withColumns({"_draw": F.xxhash64(F.col(quoted(key)), F.lit(seed)), "_key": F.col(quoted(key))})
    limit = _draw_limit(drawn, n, ["_key"])
    return df if limit is None else drawn.where(_up_to(limit, ["_key"])).drop("_draw", "_key")


def _sample_by_content(df: DataFrame, n: int, seed: int) -> DataFrame:
    """A content is known by two 64-bit hashes. Copies of many are numbered in runs, so that no task writes out all of a row's."""
    if n < 1:
        return df.limit(0)
    content = [F.col(c) for c in hashable(df)]
    known = df.withColumns({"_a": F.xxhash64(*content, F.lit(1)), "_b": F.xxhash64(*content, F.lit(2))})
    width = rows_per_task(df.sparkSession)
    counts = known.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    runs = counts.withColumn("_run", F.explode(F.expr(f"sequence(0, (_n - 1) div {width})"))).hint("rebalance")
    copies = runs.withColumn("_i", F.explode(F.expr(f"sequence(_run * {width}, least(_run * {width} + {width}, _n) - 1)")))
    copies = copies.select("_a", "_b", "_i", F.xxhash64("_a", "_b", "_i", F.lit(seed)).alias("_draw"))
    limit = _draw_limit(copies, n, ["_a", "_b", "_i"])
    if limit is None:
        return df
    chosen = copies.where(_up_to(limit, ["_a", "_b", "_i"])).groupBy("_a", "_b").agg(F.count("*").alias("_times"))
    found = known.join(F.broadcast(chosen) if n <= _SORTED_ROWS else chosen, ["_a", "_b"])
    single = found.groupBy(*[F.col(quoted(c)) for c in df.columns], "_a", "_b", "_times").count()
    return single.withColumn("_copy", F.explode(F.expr("sequence(1L, _times)"))).select(*[F.col(quoted(c)) for c in df.columns])


def sample_size(rows: int, numeric: bool, non_null: int, std: float | None, mean: float | None,
                spread: float | None, margin_percent: float = 5, confidence_percent: float = 95) -> int:
    """Rows needed so that a sample represents a column at the given confidence and margin."""
    if non_null == 0:
        return min(DEFAULT_SIZE, rows)
    z = NormalDist().inv_cdf(1 - (1 - confidence_percent / 100.0) / 2)
    margin = margin_percent / 100.0
    if numeric:
        if not std:
            return rows
        if mean is not None and abs(mean) > 1e-9:
            error = margin * abs(mean)
        elif spread is not None and spread > 1e-9:
            error = margin * spread
        else:
            error = std * 0.1
        wanted = (z * std / (error or 1e-6)) ** 2
    else:
        wanted = z * z * 0.25 / (margin or 1e-6) ** 2
    if rows > wanted:
        wanted = wanted / (1 + (wanted - 1) / rows)
    return max(1, min(math.ceil(wanted), rows))


def column_sample_size(df: DataFrame, column: str, margin_percent: float = 5, confidence_percent: float = 95) -> int:
    """``sample_size`` from one aggregate over the column; unknown columns give the default size."""
    if column not in df.columns:
        return min(DEFAULT_SIZE, df.count())
    numeric = isinstance(df.schema[column].dataType, NUMERIC_TYPES)
    col = F.col(quoted(column))
    aggs = [F.count("*").alias("rows"), F.count(col).alias("filled")]
    if numeric:
        value = col.cast("double")
        aggs += [F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"),
                 (F.max(value) - F.min(value)).alias("spread")]
    row = df.agg(*aggs).first().asDict()
    return sample_size(row["rows"], numeric, row["filled"], row.get("std"), row.get("mean"), row.get("spread"),
                       margin_percent, confidence_percent)


def representative_sample(df: DataFrame, column: str | None, margin_percent: float = 5, confidence_percent: float = 95,
                          seed: int = DEFAULT_SEED, key: str = ROW_ID, consent_rows: int | None = None) -> DataFrame:
    """Sample of the size the column asks for; more than ``consent_rows`` rows raises instead."""
    if not column or column not in df.columns:
        return sample_rows(df, DEFAULT_SIZE, seed, key)
    n = column_sample_size(df, column, margin_percent, confidence_percent)
    if consent_rows is not None and n > consent_rows:
        raise ValueError(f"sample of {n} rows exceeds the agreed {consent_rows}")
    return sample_rows(df, n, seed, key)


def sample_target(chart: str, x: str | None = None, y: str | None = None, names: str | None = None,
                  values: str | None = None, columns: list[str] | None = None) -> str | None:
    """Column whose spread decides the sample size of a chart."""
    if chart == "histogram":
        return x
    if chart == "pie":
        return values or names
    if chart == "distribution":
        return columns[0] if columns else None
    return y
