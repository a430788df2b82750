"""Type conversion with a guard against conversions that empty a column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import NUMERIC_TYPES, lenient_double
from ..functions.parse import boolean_from_text, datetime_from_text, number_from_text
from ..plans.layout import ROW_ID, quoted
from ..plans.skew import equi_join
from .windows import rank_over

# Target type names.
INTEGER, FLOAT, DATETIME = "Number (Integer64)", "Number (Float64)", "Datetime"
CATEGORY, BOOLEAN, TEXT = "Categorical", "Boolean", "String (ID Field/Key)"
TARGETS = (FLOAT, INTEGER, DATETIME, CATEGORY, BOOLEAN, TEXT)

CATEGORY_METADATA = {"semantic": "category"}
_WHOLE = r"^\s*[+-]?\d{1,19}\s*$"
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def to_numeric(col: Column, dtype: T.DataType) -> Column:
    """Number, or null where the cell is not one."""
    return lenient_double(col, dtype)


def to_float(col: Column, dtype: T.DataType) -> Column:
    """Number from text in any locale style; unreadable cells become 0."""
    return lenient_double(col, dtype) if isinstance(dtype, NUMERIC_TYPES) else number_from_text(col)


def to_integer(col: Column, dtype: T.DataType) -> Column:
    """Whole number, truncated toward zero; null beyond 64 bits."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("bigint")
    return _exact_first(col, dtype, to_float(col, dtype))


def _exact_first(col: Column, dtype: T.DataType, number: Column) -> Column:
    """Whole numbers as text are read digit by digit, as a double holds only 53 bits of them; the rest by ``number``."""
    rest = number.try_cast("bigint")
    return F.coalesce(F.when(col.rlike(_WHOLE), F.trim(col).try_cast("bigint")), rest) if isinstance(dtype, T.StringType) else rest


def to_datetime(col: Column, dtype: T.DataType) -> Column:
    """Zone-less timestamp: text through the pattern cascade, dates and timestamps by cast, numbers as epoch microseconds."""
    if isinstance(dtype, _TIMES):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, NUMERIC_TYPES):
        return F.timestamp_micros(col.try_cast("bigint")).cast("timestamp_ntz")
    return datetime_from_text(col)


def to_boolean(col: Column, dtype: T.DataType, unknown_is_false: bool = False) -> Column:
    if isinstance(dtype, T.StringType):
        return boolean_from_text(col, unknown_is_false)
    flag = col if isinstance(dtype, T.BooleanType) else col.try_cast("boolean")
    return F.coalesce(flag, F.lit(False)) if unknown_is_false else flag


def conversion(col: Column, dtype: T.DataType, target: str, unknown_is_false: bool = False) -> Column:
    """Expression that turns a column of ``dtype`` into ``target``."""
    if target == INTEGER:
        return to_integer(col, dtype)
    if target == FLOAT:
        return to_float(col, dtype)
    if target == DATETIME:
        return to_datetime(col, dtype)
    if target == BOOLEAN:
        return to_boolean(col, dtype, unknown_is_false)
    if target in (CATEGORY, TEXT):
        return col.cast("string")
    raise ValueError(f"no conversion to {target!r}")


def apply_conversion(df: DataFrame, column: str, target: str, unknown_is_false: bool = False) -> DataFrame:
    expr = conversion(F.col(quoted(column)), df.schema[column].dataType, target, unknown_is_false)
    if target == CATEGORY:
        expr = expr.alias(column, metadata=CATEGORY_METADATA)
    return df.withColumn(column, expr)


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dense 0-based code of each value in sorted order, null for null.

    The domain is collapsed before it is numbered; rows meet their code by an equi-join.
    """
    domain = df.select(F.col(quoted(column)).alias("_category")).distinct()
    coded = rank_over(domain.withColumn("_all", F.lit(0)), ["_all"], "_category", "_code", descending=False, method="dense")
    coded = coded.select("_category", (F.col("_code") - 1).cast("bigint").alias(out))
    return equi_join(df, coded, [column], ["_category"], "left", unique_right=True).drop("_category")


@dataclass(frozen=True)
class Guard:
    """When a conversion counts as harmful, as shares of new nulls."""

    of_filled: float | None
    of_rows: float
    exempt: frozenset[str]

    def flagged(self, target: str, rows: Column, before: Column, after: Column) -> Column:
        if target in self.exempt:
            return F.lit(False)
        new = after - before
        harmful = new > self.of_rows * rows
        if self.of_filled is not None:
            filled = rows - before
            harmful = harmful | ((filled > 0) & (new > self.of_filled * filled))
        return F.coalesce(harmful, F.lit(False))


# Shares above which a conversion is questioned, for one column and for batches.
SINGLE_GUARD = Guard(None, 0.10, frozenset({DATETIME}))
BATCH_GUARD = Guard(0.10, 0.05, frozenset({TEXT, BOOLEAN}))


def null_growth(df: DataFrame, targets: Mapping[str, str], guard: Guard = BATCH_GUARD,
                unknown_is_false: bool = False) -> DataFrame:
    """Nulls before and after each conversion, all columns in one pass: one row per column."""
    items = list(targets.items())
    aggs = [F.count("*").alias("_rows")]
    for i, (c, target) in enumerate(items):
        col = F.col(quoted(c))
        after = conversion(col, df.schema[c].dataType, target, unknown_is_false)
        aggs += [F.count_if(col.isNull()).alias(f"_b{i}"), F.count_if(after.isNull()).alias(f"_a{i}")]
    totals = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("target"), F.col("_rows").alias("rows"),
                     F.col(f"_b{i}").alias("nulls_before"), F.col(f"_a{i}").alias("nulls_after"),
                     guard.flagged(t, F.col("_rows"), F.col(f"_b{i}"), F.col(f"_a{i}")).alias("flagged"))
            for i, (c, t) in enumerate(items)]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


class HarmfulConversion(ValueError):
    """Raised by policy ``raise`` when a conversion would empty too many cells."""


def convert_columns(df: DataFrame, targets: Mapping[str, str], policy: str = "skip", guard: Guard = BATCH_GUARD,
                    unknown_is_false: bool = False) -> tuple[DataFrame, DataFrame]:
    """Convert several columns; returns the table and a report with one row per column.

    Policies: ``accept`` converts all and runs no job, ``warn`` converts all and reports, ``skip`` keeps
    harmful columns as they were, ``raise`` refuses. Unknown columns and targets are reported as errors.
    """
    if policy not in ("accept", "warn", "skip", "raise"):
        raise ValueError(f"unknown policy {policy!r}")
    errors = {c: ("no such column" if c not in df.columns or c == ROW_ID else f"no conversion to {t!r}")
              for c, t in targets.items() if c not in df.columns or c == ROW_ID or t not in TARGETS}
    valid = {c: t for c, t in targets.items() if c not in errors}
    growth = {}
    if valid and policy != "accept":
        growth = {r["column"]: r for r in null_growth(df, valid, guard, unknown_is_false).collect()}
    harmful = [c for c, r in growth.items() if r["flagged"]]
    if harmful and policy == "raise":
        raise HarmfulConversion(f"too many new nulls in {harmful}")
    out, report = df, []
    for c, t in targets.items():
        row = growth.get(c)
        new = row["nulls_after"] - row["nulls_before"] if row else None
        if c in errors:
            report.append((c, t, "error", new, errors[c]))
        elif c in harmful and policy == "skip":
            report.append((c, t, "skipped", new, "too many new nulls"))
        else:
            out = apply_conversion(out, c, t, unknown_is_false)
            note = "too many new nulls" if c in harmful else None
            report.append((c, t, "converted", new, note))
    schema = "column string, target string, outcome string, new_nulls bigint, note string"
    return out, df.sparkSession.createDataFrame(report, schema)


# Short type names for casting columns of a second table.
CAST_NAMES = {"String": TEXT, "Integer": INTEGER, "Float": FLOAT, "Datetime": DATETIME, "Categorical": CATEGORY,
              "Boolean": BOOLEAN}


def cast_columns(df: DataFrame, columns: list[str], type_name: str) -> DataFrame:
    """Cast columns without a guard; numbers that cannot be read become null."""
    target = CAST_NAMES[type_name]
    out = df
    for c in columns:
        dtype = df.schema[c].dataType
        col = F.col(quoted(c))
        if target == FLOAT:
            out = out.withColumn(c, to_numeric(col, dtype))
        elif target == INTEGER:
            exact = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            out = out.withColumn(c, col.cast("bigint") if exact else _exact_first(col, dtype, to_numeric(col, dtype)))
        else:
            out = apply_conversion(out, c, target)
    return out
