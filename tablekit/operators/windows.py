"""Per-group values written back to every row.

Spark runs a window group in one task. These operators use plain windows where every group is within the
rows of a task, counted beforehand; else they aggregate first and join back with hot keys split, or use range-ordered running totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.layout import ROW_ID, quoted
from ..plans.running import running_sum
from ..plans.sizing import groups_fit
from ..plans.skew import equi_join
from .aggregate import position


def aggregate_over(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each row's group as columns."""
    if groups_fit(df, keys):
        window = Window.partitionBy(*[F.col(quoted(k)) for k in keys])
        return df.withColumns({name: agg.over(window) for name, agg in aggregates.items()})
    return _joined_back(df, keys, [agg.alias(name) for name, agg in aggregates.items()])


def _joined_back(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    names = [f"_w{i}" for i in range(len(keys))]
    stats = df.groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)]).agg(*aggregates)
    return equi_join(df, stats, keys, names, "left", null_safe=True, unique_right=True).drop(*names)


def sum_over(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return aggregate_over(df, keys, {out: F.sum(F.col(quoted(value)))})


def first_over(df: DataFrame, keys: Sequence[str], value: str, out: str,
               order_by: str | Sequence[str] = ROW_ID) -> DataFrame:
    """First value of the group in table order."""
    return aggregate_over(df, keys, {out: F.min_by(F.col(quoted(value)), position(order_by))})


def cumulative_sum(df: DataFrame, keys: Sequence[str], value: str, out: str,
                   order_by: str | Sequence[str] = ROW_ID) -> DataFrame:
    """Running total inside the group in table order."""
    return running_sum(df, list(keys), [order_by] if isinstance(order_by, str) else list(order_by), value, out)


def rank_over(df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = True,
              method: str = "average") -> DataFrame:
    """Rank inside the group; ties share their average rank, or use min, max or dense. Null has no rank.

    Equal values are counted first, so the running total behind the ranks only sees distinct values.
    """
    if method not in ("average", "min", "max", "dense"):
        raise ValueError(f"unknown rank method {method!r}")
    col = F.col(quoted(value))
    if groups_fit(df, keys):
        by = col.desc_nulls_last() if descending else col.asc_nulls_last()
        ordered = Window.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(by)
        if method == "dense":
            rank = F.dense_rank().over(ordered)
        else:
            ties = F.count("*").over(Window.partitionBy(*[F.col(quoted(k)) for k in keys], col))
            rank = _shared_rank(F.rank().over(ordered), ties, method)
        return df.withColumn(out, F.when(col.isNotNull(), rank))
    names = [f"_w{i}" for i in range(len(keys))]
    counted = (df.where(col.isNotNull()).groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)],
                                                 col.alias("_rank_value")).agg(F.count("*").alias("_ties")))
    counted = counted.withColumn("_step", F.lit(1).cast("bigint") if method == "dense" else F.col("_ties"))
    ranked = running_sum(counted, names, ["_rank_value"], "_step", "_upto", descending=descending)
    rank = F.col("_upto") if method == "dense" else _shared_rank(
        F.col("_upto") - F.col("_ties") + 1, F.col("_ties"), method)
    ranked = ranked.select(*names, "_rank_value", rank.alias(out))
    joined = equi_join(df, ranked, [*keys, value], [*names, "_rank_value"], "left", null_safe=True, unique_right=True)
    return joined.drop(*names, "_rank_value")


def _shared_rank(lowest: Column, ties: Column, method: str) -> Column:
    return {"average": lowest + (ties - 1) / 2.0, "min": lowest, "max": lowest + ties - 1}[method]
