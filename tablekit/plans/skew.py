"""Equi-joins that stay balanced when one key holds a large share of either side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .layout import hashable, quoted
from .sizing import rows_per_task

_SEMI = {"left_semi", "left_anti"}


def _matches(pairs: Sequence[tuple[str, str]], null_safe: bool) -> Column:
    test = (lambda a, b: F.col(quoted(a)).eqNullSafe(F.col(quoted(b)))) if null_safe else (lambda a, b: F.col(quoted(a)) == F.col(quoted(b)))
    return reduce(lambda x, y: x & y, [test(a, b) for a, b in pairs])


def _broadcastable(left: DataFrame, right: DataFrame, how: str) -> bool:
    """Whether Spark itself would broadcast a side of this join, by its own threshold and estimate."""
    limit = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return (how in {"inner", "left", *_SEMI} and size(right) <= limit) or (how in {"inner", "right"} and size(left) <= limit)


def equi_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
              how: str = "inner", null_safe: bool = False, unique_right: bool = False) -> DataFrame:
    """Join on key pairs; column names must already be disjoint between the sides.

    Joins where Spark broadcasts a side, and those without a hot key, are left to Spark's planner. Otherwise hot keys are
    split: a key with ``n`` rows on one side gets ``ceil(n / rowsPerTask)`` salts there, and the other side's rows for that
    key are repeated once per salt. Cold keys keep a single salt. Keys with a null match nothing (unless ``null_safe``), so
    their rows are dealt out by salt as well but never repeated. The table of hot keys holds at most ``rows / rowsPerTask``
    entries per side.

    In outer joins a repeated row may miss its partner under some salts. A key is only repeated when the other side is known
    to hold it, so any such unmatched copy is spurious and is removed.

    ``unique_right`` says that no right key repeats, which spares counting that side.
    """
    pairs = list(zip(left_on, right_on, strict=True))
    if how in _SEMI:
        right, unique_right = right.select(*[F.col(quoted(c)) for c in right_on]).distinct(), True
    if _broadcastable(left, right, how):
        return left.join(right, _matches(pairs, null_safe), how)
    return _salted_join(left, right, left_on, right_on, how, null_safe, unique_right)


def join_groups(left: DataFrame, groups: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """Rows with the row of their group, null keys included; `groups` has one row per group and, as it is counted first, should be `durable`.

    Up to a hundredth of the rows of a task as groups are sent to all tasks, and the rows stay where they are. Dealt by their key, the rows of a few
    large groups would meet in as few tasks and be sorted there. More groups are joined by `equi_join`.
    """
    if groups.count() <= rows_per_task(left.sparkSession) // 100:
        return left.join(F.broadcast(groups), _matches(list(zip(left_on, right_on, strict=True)), True))
    return equi_join(left, groups, left_on, right_on, "inner", null_safe=True, unique_right=True)


def _heavy(df: DataFrame, keys: Sequence[str], width: int, salts: str, names: Sequence[str]) -> DataFrame:
    counted = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count("*").alias("_n")).where(F.col("_n") > width)
    return counted.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)],
                          F.ceil(F.col("_n") / width).cast("int").alias(salts))


def _spread(df: DataFrame, keys: Sequence[str], heavy: DataFrame, names: Sequence[str], own: str, other: str,
            own_salt: str, other_salt: str, null_safe: bool) -> DataFrame:
    """Give each row its own salt and repeat it once per salt of the other side.

    ``own`` and ``other`` name the salt counts in ``heavy``; a count that is not there means one salt.
    The salt follows from the row and its input partition, so a re-run task gives the same one.
    """
    joined = (df.withColumn("_where", F.spark_partition_id())
              .join(F.broadcast(heavy), _matches(list(zip(keys, names)), True), "left"))
    meets = F.lit(True) if null_safe else reduce(lambda a, b: a & b, [F.col(quoted(k)).isNotNull() for k in keys])
    salt = repeat = F.lit(0)
    if own in heavy.columns:
        content = F.xxhash64(*[F.col(c) for c in hashable(df)], F.col("_where"))
        salt = F.pmod(content, F.coalesce(F.col(own), F.lit(1))).cast("int")
    if other in heavy.columns:
        joined = joined.withColumn(other, F.when(meets, F.col(other)))
        repeat = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    return joined.withColumn(own_salt, salt).withColumn(other_salt, repeat).drop("_where", own, *names)


def _salted_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str,
                 null_safe: bool, unique_right: bool) -> DataFrame:
    width = rows_per_task(left.sparkSession)
    names = [f"_hot{i}" for i in range(len(left_on))]
    heavy_left = _heavy(left, left_on, width, "_sl", names)
    if unique_right:
        heavy = heavy_left
    else:
        heavy_right = _heavy(right, right_on, width, "_sr", names)
        heavy = (heavy_left.withColumn("_sr", F.lit(None).cast("int"))
                 .unionByName(heavy_right.withColumn("_sl", F.lit(None).cast("int")))
                 .groupBy(*names).agg(F.max("_sl").alias("_sl"), F.max("_sr").alias("_sr")))
    hot = heavy.collect()  # at most rows / rowsPerTask of either side
    if not hot:
        return left.join(right, _matches(list(zip(left_on, right_on)), null_safe), how)
    heavy = left.sparkSession.createDataFrame(hot, heavy.schema)
    lhs = _spread(left, left_on, heavy, names, "_sl", "_sr", "_li", "_lj", null_safe)
    split = F.lit(False) if unique_right else F.col("_sr").isNotNull()
    lhs = lhs.withColumns({"_split_right": split, "_in_left": F.lit(True)}).drop("_sr")
    rhs = _spread(right, right_on, heavy, names, "_sr", "_sl", "_rj", "_ri", null_safe)
    rhs = rhs.withColumns({"_split_left": F.col("_sl").isNotNull(), "_in_right": F.lit(True)}).drop("_sl")
    on = (_matches(list(zip(left_on, right_on)), null_safe)
          & (F.col("_li") == F.col("_ri")) & (F.col("_lj") == F.col("_rj")))
    out = lhs.join(rhs, on, how)
    helpers = ["_li", "_lj", "_ri", "_rj", "_split_right", "_split_left", "_in_left", "_in_right"]
    if how in {"left", "full"}:
        out = out.where(~(F.col("_in_right").isNull() & F.coalesce(F.col("_split_right"), F.lit(False))))
    if how in {"right", "full"}:
        out = out.where(~(F.col("_in_left").isNull() & F.coalesce(F.col("_split_left"), F.lit(False))))
    return out.drop(*helpers)
