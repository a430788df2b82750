"""Column operators: derive, drop, rename, choose by type, page, promote a header row, display text, marker sizes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import INTEGRAL_TYPES, lenient_double
from ..plans.layout import ROW_ID, quoted, with_row_id

_FLOATS = (T.FloatType, T.DoubleType)
_NUMBERS = (*INTEGRAL_TYPES, *_FLOATS)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.TimeType)
_TEXT = (T.StringType,)
_CATEGORICAL = (T.StringType, T.BooleanType)

TYPE_CLASSES = {
    "integer": INTEGRAL_TYPES, "float": _FLOATS, "numeric": _NUMBERS, "temporal": _TEMPORAL, "string": _TEXT,
    "categorical": _CATEGORICAL, "numeric_temporal": _NUMBERS + _TEMPORAL,
    "sortable": _NUMBERS + _TEMPORAL + _CATEGORICAL,
}


def create_column(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """Add or overwrite a column from SQL text or a Column; analysis errors surface at once."""
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def columns_of_type(df: DataFrame, classes: Iterable[str] | str | None = None) -> list[str]:
    """Names of the columns in any of the type classes; the row id is never among them."""
    wanted = [classes] if isinstance(classes, str) else list(classes or ["all"])
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    if "all" in wanted:
        return [f.name for f in fields]
    types = tuple(t for c in wanted for t in TYPE_CLASSES[c])
    return [f.name for f in fields if isinstance(f.dataType, types)]


def select_by_type(df: DataFrame, classes: Iterable[str] | str | None = None) -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in columns_of_type(df, classes)])


def head(df: DataFrame, n: int = 1000) -> DataFrame:
    """First rows for display. With a row id they are the first by id, found by a range test."""
    return df.where(F.col(ROW_ID) < n) if ROW_ID in df.columns else df.limit(n)


def row_slice(df: DataFrame, offset: int, length: int | None = None, key: str = ROW_ID) -> DataFrame:
    """Rows ``offset .. offset+length-1`` by a consecutive row id: a range test, no sort."""
    out = df.where(F.col(key) >= offset)
    return out if length is None else out.where(F.col(key) < offset + length)


def row_page(df: DataFrame, page: int, size: int = 500, key: str = ROW_ID) -> DataFrame:
    return row_slice(df, page * size, size, key)


def tail(df: DataFrame, n: int, key: str = ROW_ID) -> DataFrame:
    """Last rows by a consecutive row id."""
    last = df.agg(F.max(key)).scalar()
    return df.where(F.col(key) > last - n)


def header_names(values: Sequence[object]) -> list[str]:
    """Unique, non-empty names: blanks become ``col_<position>``, repeats get ``_2``, ``_3``..."""
    names, seen = [], set()
    for i, value in enumerate(values):
        base = str(value).strip() if value is not None and str(value).strip() else f"col_{i}"
        name, k = base, 2
        while name.lower() in seen:
            name, k = f"{base}_{k}", k + 1
        seen.add(name.lower())
        names.append(name)
    return names


def promote_header(df: DataFrame, row: int, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """Use row ``row`` as column names, keep the rows after it, renumber from 0.

    Needs consecutive ids; they are added (in ``order_by`` order) when absent. Only the header row
    reaches the driver.
    """
    numbered = df if ROW_ID in df.columns else with_row_id(df, order_by)
    columns = [c for c in numbered.columns if c != ROW_ID]
    found = numbered.where(F.col(ROW_ID) == row).select(*[F.col(quoted(c)) for c in columns]).take(1)
    if not found:
        raise ValueError(f"no row {row}")
    names = header_names(list(found[0]))
    return numbered.where(F.col(ROW_ID) > row).select(
        *[F.col(quoted(c)).alias(n) for c, n in zip(columns, names)], (F.col(ROW_ID) - row - 1).alias(ROW_ID))


def display_column(col: Column, dtype: T.DataType, missing: str = "N/A") -> Column:
    """Display string of a value: dates with a clock time, everything else by cast, null as ``missing``."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(missing))


def display_text(df: DataFrame, columns: Sequence[str] | None = None, missing: str = "N/A") -> DataFrame:
    """Columns as display strings."""
    return df.select(*[display_column(F.col(quoted(c)), df.schema[c].dataType, missing).alias(c)
                       for c in columns or df.columns])


def marker_size(df: DataFrame, column: str, out: str = "marker_size") -> DataFrame:
    """Scale a column to marker sizes in [2, 50]: shift by |min|, ten times the ratio to the mean.

    The two statistics are a scalar subquery, so the table itself is never shuffled.
    """
    value = F.coalesce(lenient_double(F.col(quoted(column)), df.schema[column].dataType), F.lit(0.0))
    stats = df.agg(F.struct(F.abs(F.min(value)).alias("shift"), F.avg(value).alias("mean")).alias("s")).scalar()
    mean = stats["mean"] + stats["shift"]
    scaled = F.when(F.abs(mean) > 1e-9, F.try_divide(10 * (value + stats["shift"]), mean)).otherwise(value)
    return df.withColumn(out, F.greatest(F.least(scaled, F.lit(50.0)), F.lit(2.0)))
