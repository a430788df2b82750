"""Decisions between a plain Spark plan and a skew-safe one, from counted rows.

``tablekit.rowsPerTask`` (a session setting) is the number of rows one task may hold of a key. A key with more is "hot" and
gets split. The number of hot keys is at most ``rows / rowsPerTask``, which bounds what is broadcast. Counting reads the key
columns alone and is combined before the shuffle; stored size says nothing, as a file of few bytes can hold very many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_TASK = 5_000_000


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get("tablekit.rowsPerTask", str(ROWS_PER_TASK)))


def groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every group of equal keys (the whole table, without keys) is within the rows of a task."""
    from .layout import quoted

    counts = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count("*").alias("_n"))
    return (counts.agg(F.max("_n")).first()[0] or 0) <= rows_per_task(df.sparkSession)
