"""Type suggestions for text columns, from one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import INTEGRAL_TYPES, lenient_double
from ..functions.parse import datetime_from_text
from ..plans.layout import ROW_ID, columns_apart, quoted
from .convert import (BOOLEAN, CATEGORY, CATEGORY_METADATA, DATETIME, FLOAT, INTEGER, TARGETS, TEXT,
                      convert_columns)
from .profile import distinct_count

# Words that make a column boolean, in the main and in the wider vocabulary.
BOOLEAN_WORDS = ["true", "yes", "false", "no"]
WIDE_BOOLEAN_WORDS = ["true", "yes", "1", "t", "false", "no", "0", "f"]
# Shares of unreadable cells, and limits on category sizes.
MAX_FAILED_SHARE = 0.05
MAX_CATEGORIES = 50
MAX_CATEGORY_SHARE = 0.1

_FACTS = ("filled", "not_date", "not_bool", "not_int", "not_number", "fractional")
#: Columns parsed by one aggregate, which bounds its generated code.
_COLUMNS_AT_ONCE = 2


def _parsed(v: Column, words: Sequence[str]) -> dict[str, Column]:
    return {"number": lenient_double(v, T.StringType()), "undated": datetime_from_text(v, serials=False).isNull(),
            "flag": F.lower(v).isin(list(words)), "broken": F.when(v.rlike(r"^\s*[+-]?\d{1,19}\s*$"), v.try_cast("bigint")).isNull()}


def _counted(filled: Column, number: Column, undated: Column, flag: Column, broken: Column) -> dict[str, Column]:
    return {"filled": F.count_if(filled), "not_date": F.count_if(filled & undated), "not_bool": F.count_if(filled & ~flag),
            "not_int": F.count_if(filled & broken), "not_number": F.count_if(filled & number.isNull()),
            "fractional": F.count_if(filled & (number % 1 != 0))}


def _evidence(df: DataFrame, columns: Sequence[str], words: Sequence[str]) -> dict[str, Mapping[str, int]]:
    """Counts per text column; every rule is decided from these. Each cell is parsed once, before they are taken.

    Where columns can be read apart, a few at a time share an aggregate, which leaves one row of counts per task; the branches run in one job and
    each column is read once. Other tables are read once: their cells become rows.
    """
    if columns_apart(df):
        branches = []
        for some in (columns[i:i + _COLUMNS_AT_ONCE] for i in range(0, len(columns), _COLUMNS_AT_ONCE)):
            narrow = df.select(*[e.alias(f"{k}{i}") for i, c in enumerate(some)
                                 for k, e in {"filled": F.col(quoted(c)).isNotNull(), **_parsed(F.col(quoted(c)), words)}.items()])
            totals = narrow.agg(*[e.alias(f"{k}{i}") for i in range(len(some))
                                  for k, e in _counted(*[F.col(f"{k}{i}") for k in ("filled", "number", "undated", "flag", "broken")]).items()])
            branches.append(totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in _FACTS])
                                                              for i, c in enumerate(some)])).alias("c")).select("c.*"))
        facts = reduce(DataFrame.unionAll, branches)
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("v")) for c in columns]))
        parsed = df.select(cells.alias("c")).select("c.column", "c.v").where("v is not null").select("column", *[
            e.alias(k) for k, e in _parsed(F.col("v"), words).items()])
        facts = parsed.groupBy("column").agg(*[e.alias(k) for k, e in _counted(
            F.lit(True), *[F.col(k) for k in ("number", "undated", "flag", "broken")]).items()])
    return {r["column"]: r for r in facts.collect() if r["filled"]}


def _suggest(e, distinct: int | None) -> str | None:
    """Rules in order of preference; None asks for the distinct count."""
    filled = e["filled"]
    if e["not_date"] / filled <= MAX_FAILED_SHARE:
        return DATETIME
    if e["not_bool"] == 0:
        return BOOLEAN
    if e["not_int"] == 0:
        return INTEGER
    if e["not_number"] / filled <= MAX_FAILED_SHARE:
        return FLOAT if e["fractional"] else INTEGER
    if distinct is None:
        return None
    return CATEGORY if distinct <= MAX_CATEGORIES or distinct / filled <= MAX_CATEGORY_SHARE else TEXT


def _typed_class(field: T.StructField) -> str | None:
    """Class of a column that is not text."""
    dtype = field.dataType
    if isinstance(dtype, T.StringType):
        return CATEGORY if field.metadata.get("semantic") == CATEGORY_METADATA["semantic"] else None
    if isinstance(dtype, INTEGRAL_TYPES):
        return INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return BOOLEAN if isinstance(dtype, T.BooleanType) else TEXT


def suggest_types(df: DataFrame, columns: Sequence[str] | None = None, wide_booleans: bool = False) -> DataFrame:
    """Suggested type per column: rows ``(column, current_type, suggestion)``.

    Evidence is counted in one job, with generated code of a bounded size however wide the table; distinct values are counted only
    for the columns no earlier rule settles. What reaches the driver is one row per column.
    """
    fields = [f for f in df.schema.fields if f.name != ROW_ID and (columns is None or f.name in columns)]
    words = WIDE_BOOLEAN_WORDS if wide_booleans else BOOLEAN_WORDS
    found = {f.name: _typed_class(f) for f in fields}
    text = [c for c, s in found.items() if s is None]
    typed = [c for c, s in found.items() if s is not None]
    if typed:
        filled = df.agg(*[F.count(F.col(quoted(c))).alias(f"_t{i}") for i, c in enumerate(typed)]).first()
        found.update({c: TEXT for i, c in enumerate(typed) if not filled[f"_t{i}"]})
    evidence = {}
    if text:
        evidence = _evidence(df, text, words)
        found.update({c: TEXT for c in text if c not in evidence})
    found.update({c: _suggest(e, None) for c, e in evidence.items()})
    unsettled = [c for c in text if found[c] is None]
    if unsettled:
        counts = {r["column"]: r["n_unique"] for r in distinct_count(df, unsettled, with_null=False).collect()}
        found.update({c: _suggest(evidence[c], counts[c]) for c in unsettled})
    rows = [(f.name, f.dataType.simpleString(), found[f.name]) for f in fields]
    return df.sparkSession.createDataFrame(rows, "column string, current_type string, suggestion string")


def apply_suggestions(df: DataFrame, accepted: Mapping[str, str], policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Convert accepted suggestions where the type differs, numbers first and text last."""
    fields = {f.name: f for f in df.schema.fields}
    todo = {c: t for target in TARGETS for c, t in accepted.items()
            if t == target and _typed_class(fields[c]) != target and not (
                target == TEXT and isinstance(fields[c].dataType, T.StringType))}
    return convert_columns(df, todo, policy)
