"""Rows chosen by how often, or in which position, a column value occurs. Null counts as a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.layout import ROW_ID, quoted
from ..plans.skew import equi_join

FIRST, LAST = "Is First Occurrence (Column)", "Is Last Occurrence (Column)"
DUPLICATE, UNIQUE = "Is Any Duplicate (Column)", "Is Only Unique (Column)"
OCCURRENCE_KINDS = (FIRST, LAST, DUPLICATE, UNIQUE)


def _listed(order_by: Sequence[str] | str) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def first_occurrence(df: DataFrame, column: str | Sequence[str], order_by: Sequence[str] | str = ROW_ID,
                     last: bool = False) -> DataFrame:
    """First (or last) row of each distinct value, in ``order_by`` order.

    Spark trims every input partition to one row per value before the shuffle (window group limit),
    so a hot value sends at most one row per partition.
    """
    keys = [F.col(quoted(k)) for k in _listed(order_by)]
    order = [k.desc_nulls_last() if last else k.asc_nulls_first() for k in keys]
    window = Window.partitionBy(*[F.col(quoted(c)) for c in _listed(column)]).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def last_occurrence(df: DataFrame, column: str | Sequence[str], order_by: Sequence[str] | str = ROW_ID) -> DataFrame:
    return first_occurrence(df, column, order_by, last=True)


def _repeated(df: DataFrame, column: str | Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Values that occur more than once, the columns of ``df`` and those of the values."""
    keys = _listed(column)
    names = [f"_k{i}" for i in range(len(keys))]
    counted = df.groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias("_n"))
    return counted.where("_n > 1").select(*names), keys, names


def only_unique(df: DataFrame, column: str | Sequence[str]) -> DataFrame:
    """Rows whose value occurs once: values are counted without the rows, then those with a repeated one are left out."""
    return equi_join(df, *_repeated(df, column), "left_anti", null_safe=True)


def any_duplicate(df: DataFrame, column: str | Sequence[str]) -> DataFrame:
    """Rows whose value occurs more than once."""
    return equi_join(df, *_repeated(df, column), "left_semi", null_safe=True)


def with_occurrence_flags(df: DataFrame, wanted: Sequence[tuple[str, str, str]],
                          order_by: Sequence[str] | str = ROW_ID) -> DataFrame:
    """Add boolean columns; ``wanted`` holds ``(flag name, column, kind)``.

    Counts and first/last positions come from one light aggregate per column. Position flags join back
    on the row key, which is unique, and count flags on the value with hot values split, so no
    task receives a whole hot group. ``order_by`` must identify rows when a position flag is asked for.
    """
    keys, base = _listed(order_by), df
    for i, (flag, column, kind) in enumerate(wanted):
        value = f"_v{i}"
        if kind in (DUPLICATE, UNIQUE):
            counts = base.groupBy(F.col(quoted(column)).alias(value)).agg(F.count("*").alias(f"_n{i}"))
            chosen = counts.where(F.col(f"_n{i}") > 1)
            df = equi_join(df, chosen, [column], [value], "left", null_safe=True, unique_right=True)
            hit = F.col(f"_n{i}").isNotNull()
            df = df.withColumn(flag, hit if kind == DUPLICATE else ~hit).drop(value, f"_n{i}")
        else:
            position = F.struct(*[F.col(quoted(k)) for k in keys]) if len(keys) > 1 else F.col(quoted(keys[0]))
            pick = F.min(position) if kind == FIRST else F.max(position)
            spots = base.groupBy(F.col(quoted(column)).alias(value)).agg(pick.alias("_spot"))
            names = [f"_p{i}_{j}" for j in range(len(keys))]
            parts = [F.col("_spot")[k] for k in keys] if len(keys) > 1 else [F.col("_spot")]
            spots = spots.select(*[p.alias(n) for p, n in zip(parts, names)], F.lit(True).alias(f"_hit{i}"))
            df = equi_join(df, spots, keys, names, "left", null_safe=True, unique_right=True)
            df = df.withColumn(flag, F.col(f"_hit{i}").isNotNull()).drop(*names, f"_hit{i}")
    return df
