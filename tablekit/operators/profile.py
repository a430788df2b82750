"""Column and table profiles: fill rates, distinct counts, numeric and date summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import INTEGRAL_TYPES, NUMERIC_TYPES, lenient_double
from ..plans.layout import ROW_ID, columns_apart, quoted
from ..plans.running import column_quantiles
from ..plans.sizing import groups_fit


def value_counts(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """Most frequent values; equal counts are ordered by value."""
    col = F.col(quoted(column))
    counts = df.groupBy(col.alias(column)).agg(F.count("*").alias("count"))
    if top is None:
        return counts
    return counts.orderBy(F.col("count").desc(), F.col(quoted(column)).asc_nulls_first()).limit(top)


def category_domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    col = F.col(quoted(column))
    return df.select(col).where(col.isNotNull()).distinct().orderBy(col)


def distinct_count(df: DataFrame, columns: Sequence[str], approx: bool = False, with_null: bool = True) -> DataFrame:
    """Distinct values per column, null counted as one unless ``with_null`` is off: rows ``(column, n_unique)``.

    Where the columns can be read apart (a scan of Parquet or ORC), each is counted by itself: its copies collapse on the map side and only its
    distinct values are moved. Any other table is read once: its cells become ``(column, value)`` pairs. The text of a value is its identity.
    """
    if approx:
        found = df.agg(*[(F.approx_count_distinct(F.col(quoted(c)), 0.01)
                          + (F.max(F.col(quoted(c)).isNull().cast("int")) if with_null else 0)).cast("bigint").alias(c)
                         for c in columns])
        return found.unpivot([], [F.col(quoted(c)) for c in columns], "column", "n_unique")
    count = (F.count("*") if with_null else F.count("value")).alias("n_unique")
    if columns and columns_apart(df):
        return reduce(DataFrame.unionAll, [df.select(_identity(df, c).alias("value")).distinct().agg(count).select(F.lit(c).alias("column"), "n_unique")
                                           for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value"))
                                for c in columns]))
    pairs = df.select(cells.alias("c")).select("c.column", "c.value").distinct()
    return pairs.groupBy("column").agg(count)


def _identity(df: DataFrame, column: str) -> Column:
    """The value itself where equal values have equal texts and the other way round, else its text."""
    kind, col = df.schema[column].dataType, F.col(quoted(column))
    return col if isinstance(kind, (*INTEGRAL_TYPES, T.DecimalType, T.BooleanType, T.DateType)) else col.cast("string")


def fill_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, filled and empty cells and their percentages per column, from one pass without a shuffle of rows."""
    columns = [c for c in (columns or df.columns) if c != ROW_ID]
    totals = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(quoted(c))).alias(f"_f{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_f{i}").alias("non_null"))
                               for i, c in enumerate(columns)]))
    share = lambda n: F.coalesce(F.try_divide(n * 100.0, F.col("rows")), F.lit(0.0))
    return (totals.select(F.col("_rows").alias("rows"), rows.alias("c"))
            .select("c.column", "rows", "c.non_null", (F.col("rows") - F.col("c.non_null")).alias("null_count"))
            .withColumns({"fill_pct": share(F.col("non_null")), "null_pct": share(F.col("null_count"))}))


_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def numeric_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Sum, mean, spread, quartiles and sign counts: one row per numeric column.

    Moments of all columns come from one pass in generated code; percentiles, which have none, are kept
    out of it. They are exact by default: tables within the rows of a task use the built-in,
    others are searched by `column_quantiles`, which moves no rows.
    """
    number = {c: lenient_double(F.col(quoted(c)), df.schema[c].dataType) for c in columns}
    moments = {"count": F.count, "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp, "min": F.min, "max": F.max,
               "zeros": lambda v: F.count_if(v == 0), "positive": lambda v: F.count_if(v > 0),
               "negative": lambda v: F.count_if(v < 0)}
    wide = df.agg(*[agg(v).alias(f"_{name}{i}") for i, v in enumerate(number.values()) for name, agg in moments.items()])
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("_i"), *[F.col(f"_{name}{i}").alias(name) for name in moments])
        for i, c in enumerate(columns)])).alias("s")).select("s.*")
    fractions = list(_QUARTILES.values())
    if approx:
        fractions = list(_QUARTILES.values())
        found = df.agg(F.array(*[F.percentile_approx(v, fractions, 10_000) for v in number.values()]).alias("q")).scalar()
    else:
        found = _quartiles(df, number)
    mine = F.get(found, F.col("_i"))
    return rows.withColumns({n: mine[i] for i, n in enumerate(_QUARTILES)}).drop("_i")


def _quartiles(df: DataFrame, number: Mapping[str, Column]) -> Column:
    """An array with the exact quartiles of each column, as an array. Tables within the rows of a task use the built-in."""
    if groups_fit(df, []):
        fractions = F.array(*map(F.lit, _QUARTILES.values()))
        return df.agg(F.array(*[F.percentile(v, fractions) for v in number.values()]).alias("q")).scalar()
    found = column_quantiles(df, number, _QUARTILES)
    return F.array(*[F.array(*[F.lit(found[c][n]).cast("double") for n in _QUARTILES]) for c in number])


def datetime_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Earliest, latest and span per column, the span split as years of 365 and months of 30 days."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(F.col(quoted(c))).cast("timestamp_ntz").alias("earliest"),
                             F.max(F.col(quoted(c))).cast("timestamp_ntz").alias("latest")).alias(f"_s{i}")
                    for i, c in enumerate(columns)])
    rows = wide.select(F.explode(F.array(*[f"_s{i}" for i in range(len(columns))])).alias("s")).select("s.*")
    days = F.timestamp_diff("DAY", F.col("earliest"), F.col("latest"))
    total = F.col("total_days")
    return rows.withColumn("total_days", days).withColumns({
        "years": F.floor(total / 365), "months": F.floor(F.pmod(total, F.lit(365)) / 30),
        "days": F.pmod(F.pmod(total, F.lit(365)), F.lit(30))})


def describe_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, null_count, mean, std, min, 25%, 50%, 75%, max of every column: one row per statistic.

    Cells are text, so that numbers, dates and words share a column. Text columns have no mean, std
    or quartiles; dates have no mean or std.
    """
    columns = [c for c in (columns or df.columns) if c != ROW_ID]
    types = {c: df.schema[c].dataType for c in columns}
    numeric = [c for c in columns if isinstance(types[c], NUMERIC_TYPES)]
    simple = [c for c in columns if not isinstance(types[c], (T.ArrayType, T.MapType, T.StructType))]
    base = []
    for i, c in enumerate(columns):
        col = F.col(quoted(c))
        base += [F.count(col).alias(f"_n{i}"), F.count_if(col.isNull()).alias(f"_z{i}")]
        if c in simple:
            base += [F.min(col).alias(f"_lo{i}"), F.max(col).alias(f"_hi{i}")]
        if c in numeric:
            base += [F.avg(col).alias(f"_avg{i}"), F.stddev_samp(col).alias(f"_sd{i}")]
    totals = df.agg(*base)
    if numeric:
        quartiles = _quartiles(df, {c: F.col(quoted(c)).cast("double") for c in numeric})
        totals = totals.withColumn("_q", quartiles).select("*", *[F.col("_q")[k][j].alias(f"_{q}{columns.index(c)}")
                                                                  for k, c in enumerate(numeric) for j, q in enumerate(_QUARTILES)]).drop("_q")
    known = set(totals.columns)

    def cell(prefix: str, i: int) -> Column:
        name = f"{prefix}{i}"
        return F.col(name).cast("string") if name in known else F.lit(None).cast("string")

    labels = {"count": "_n", "null_count": "_z", "mean": "_avg", "std": "_sd", "min": "_lo",
              "25%": "_q1", "50%": "_median", "75%": "_q3", "max": "_hi"}
    rows = F.explode(F.array(*[F.struct(F.lit(label).alias("statistic"),
                                        *[cell(p, i).alias(c) for i, c in enumerate(columns)])
                               for label, p in labels.items()]))
    return totals.select(rows.alias("r")).select("r.*")
