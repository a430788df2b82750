"""Structured filters (typed conditions folded left to right) and free-form SQL filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.numeric import INTEGRAL_TYPES, lenient_double
from ..plans.layout import ROW_ID, quoted
from .occurrence import DUPLICATE, FIRST, LAST, OCCURRENCE_KINDS, UNIQUE, any_duplicate, first_occurrence, \
    only_unique, with_occurrence_flags


@dataclass(frozen=True)
class Condition:
    """One predicate. ``field_type`` is String, Numeric or Date and selects the comparison rules."""

    column: str
    comparison: str
    value: str = ""
    value2: str = ""
    case_sensitive: bool = False
    field_type: str = "String"
    use_regex: bool = False
    negate: bool = False


class BadLiteral(ValueError):
    """A literal that does not fit the condition's field type."""


def _never() -> Column:
    return F.lit(False)


def _compare(col: Column, sign: str, value) -> Column:
    return {"Equals": lambda: col == value, ">": lambda: col > value, "<": lambda: col < value,
            ">=": lambda: col >= value, "<=": lambda: col <= value}[sign]()


_SIGNS = ("Equals", ">", "<", ">=", "<=")


def _check_pattern(pattern: str) -> None:
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:  # the gateway wraps PatternSyntaxException
        raise BadLiteral(f"bad pattern {pattern!r}") from error


def string_condition(col: Column, comparison: str, value: str, value2: str = "", case_sensitive: bool = False,
                     use_regex: bool = False, dtype: T.DataType | None = None) -> Column:
    """Text predicate; null behaves as the empty string."""
    raw = col if isinstance(dtype, T.StringType) else col.cast("string")
    text = F.coalesce(raw, F.lit(""))
    if comparison == "Empty":
        return col.isNull() | (text == "")
    if use_regex:
        prefix = "" if case_sensitive else "(?i)"
        if comparison == "Equals":
            pattern = f"{prefix}^(?:{value})$"
        elif comparison == "Contains":
            pattern = prefix + value
        else:
            return _never()
        _check_pattern(pattern)
        return text.rlike(pattern)
    if case_sensitive and comparison == "Equals" and value:
        return raw.eqNullSafe(F.lit(value))  # reaches the scan, unlike the coalesce form
    fold = (lambda c: c) if case_sensitive else F.lower
    text, literal = fold(text), fold(F.lit(value))
    if comparison == "Contains":
        return F.contains(text, literal)
    if comparison in _SIGNS:
        return _compare(text, comparison, literal)
    if comparison == "Between":
        if not value2:
            return _never()
        other = fold(F.lit(value2))
        return text.between(F.least(literal, other), F.greatest(literal, other))
    return _never()


def _number(text: str) -> float | None:
    if not text:
        return None
    try:
        return float(text)
    except ValueError as error:
        raise BadLiteral(f"not a number: {text!r}") from error


def _decimal(text: str) -> Decimal:
    """The number as written; text that only float() reads goes by its value."""
    try:
        return Decimal(text.strip())
    except InvalidOperation:
        return Decimal(float(text))


def _integral_compare(col: Column, sign: str, value: Decimal) -> Column:
    """Compare a whole-number column, exactly over all 64 bits and without casting it, so the test reaches the scan."""
    whole = int(value.to_integral_value({">": ROUND_FLOOR, "<": ROUND_CEILING, ">=": ROUND_CEILING, "<=": ROUND_FLOOR, "Equals": ROUND_FLOOR}[sign]))
    if sign == "Equals" and whole != value or not -2**63 <= whole < 2**63:
        always = sign in (("<", "<=") if whole > 0 else (">", ">=")) and sign != "Equals"
        return F.when(col.isNotNull(), always)
    return _compare(col, sign, F.lit(whole).cast("bigint"))


def numeric_condition(col: Column, comparison: str, value: str, value2: str = "",
                      dtype: T.DataType | None = None) -> Column:
    """Number predicate after a lenient cast; ``Equals`` with a blank value finds missing numbers."""
    if comparison == "Empty":
        return col.isNull()
    number = lenient_double(col, dtype)
    first = _number(value)
    if first is None:
        return number.isNull() if comparison == "Equals" else _never()
    second = _number(value2) if comparison == "Between" else None
    if isinstance(dtype, INTEGRAL_TYPES) and all(v is None or math.isfinite(v) for v in (first, second)):
        first, second = _decimal(value), None if second is None else _decimal(value2)
        test = lambda sign, v: _integral_compare(col, sign, v)
    else:
        test = lambda sign, v: _compare(number, sign, F.lit(v))
    if comparison in _SIGNS:
        return test(comparison, first)
    if comparison == "Between":
        if second is None:
            return _never()
        low, high = sorted((first, second))
        return test(">=", low) & test("<=", high)
    return _never()


def _day(text: str) -> date | None:
    if not text:
        return None
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as error:
        raise BadLiteral(f"not a date: {text!r}") from error


def date_condition(col: Column, comparison: str, value: str, value2: str = "",
                   dtype: T.DataType | None = None) -> Column:
    """Calendar-day predicate. Text is read as ``yyyy-MM-dd``; timestamps compare by their day.

    On timestamps the day test is written as a half-open range on the column itself, which the scan
    can use, where ``cast(column as date)`` would hide it.
    """
    if comparison == "Empty":
        return col.isNull()
    first = _day(value)
    if first is None:
        return _never()
    second = _day(value2) if comparison == "Between" else None
    if comparison == "Between" and second is None:
        return _never()
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        kind = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
        start = lambda d: F.lit(d.isoformat() + " 00:00:00").cast(kind)
        after = lambda d: start(d + timedelta(days=1))
        tests = {"Equals": lambda d: (col >= start(d)) & (col < after(d)), ">": lambda d: col >= after(d),
                 "<": lambda d: col < start(d), ">=": lambda d: col >= start(d), "<=": lambda d: col < after(d)}
    else:
        if isinstance(dtype, T.StringType):
            shaped = F.when(col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), col)
            day = shaped.try_cast("date")
        elif dtype is None or isinstance(dtype, T.DateType):
            day = col.try_cast("date") if dtype is None else col
        else:
            day = F.lit(None).cast("date")
        tests = {s: (lambda d, s=s: _compare(day, s, F.lit(d))) for s in _SIGNS}
    tests["Contains"] = tests["Equals"]
    if comparison == "Between":
        low, high = sorted((first, second))
        return tests[">="](low) & tests["<="](high)
    return tests[comparison](first) if comparison in tests else _never()


def condition_column(cond: Condition, schema: T.StructType, on_error: str = "false") -> Column:
    """Compile one value predicate. Bad literals and unknown columns give false, or raise on request."""
    try:
        if cond.column not in schema.fieldNames():
            raise BadLiteral(f"no column {cond.column!r}")
        dtype = schema[cond.column].dataType
        col = F.col(quoted(cond.column))
        if cond.field_type == "Date":
            test = date_condition(col, cond.comparison, cond.value, cond.value2, dtype)
        elif cond.field_type == "Numeric":
            test = numeric_condition(col, cond.comparison, cond.value, cond.value2, dtype)
        else:
            test = string_condition(col, cond.comparison, cond.value, cond.value2, cond.case_sensitive,
                                    cond.use_regex, dtype)
    except BadLiteral:
        if on_error == "raise":
            raise
        test = _never()
    return ~test if cond.negate else test


def _fold(items: Sequence[Condition | str], compiled: dict[int, Column]) -> Column | None:
    """Left fold without precedence: ``((c1 op c2) op c3)``; a missing operator means and."""
    out, operator = None, "and"
    for i, item in enumerate(items):
        if isinstance(item, str):
            operator = item.lower() if out is not None else "and"
        else:
            test = compiled[i]
            out = test if out is None else (out | test if operator == "or" else out & test)
            operator = "and"
    return out


def compile_filter(items: Sequence[Condition | str], schema: T.StructType, on_error: str = "false") -> Column | None:
    """One Column for a list alternating conditions and ``"and"``/``"or"``; None when there is no condition."""
    compiled = {i: condition_column(c, schema, on_error) for i, c in enumerate(items) if isinstance(c, Condition)}
    return _fold(items, compiled)


def _is_occurrence(item) -> bool:
    return isinstance(item, Condition) and item.comparison in OCCURRENCE_KINDS \
        and item.field_type not in ("Date", "Numeric")


def apply_filter(df: DataFrame, items: Sequence[Condition | str], order_by: Sequence[str] | str = ROW_ID,
                 on_error: str = "false") -> DataFrame:
    """Filter a table by structured conditions; without any, the table comes back unchanged."""
    conditions = [i for i in items if isinstance(i, Condition)]
    if not any(_is_occurrence(c) for c in conditions):
        test = compile_filter(items, df.schema, on_error)
        return df if test is None else df.where(test)
    if len(conditions) == 1 and not conditions[0].negate:
        only = conditions[0]
        if only.column not in df.columns:
            if on_error == "raise":
                raise BadLiteral(f"no column {only.column!r}")
            return df.where(_never())
        direct = {FIRST: lambda: first_occurrence(df, only.column, order_by),
                  LAST: lambda: first_occurrence(df, only.column, order_by, last=True),
                  DUPLICATE: lambda: any_duplicate(df, only.column), UNIQUE: lambda: only_unique(df, only.column)}
        return direct[only.comparison]()
    compiled, wanted = {}, []
    for i, item in enumerate(items):
        if _is_occurrence(item) and item.column in df.columns:
            wanted.append((f"_flag{i}", item.column, item.comparison))
            flag = F.col(f"_flag{i}")
            compiled[i] = ~flag if item.negate else flag
        elif isinstance(item, Condition):
            compiled[i] = condition_column(item, df.schema, on_error)
    flagged = with_occurrence_flags(df, wanted, order_by)
    return flagged.where(_fold(items, compiled)).select(*[F.col(quoted(c)) for c in df.columns])


def where_sql(df: DataFrame, text: str) -> DataFrame:
    """Free-form boolean SQL over the columns; a bad expression raises before any data is read."""
    try:
        return df.where(F.expr(text))
    except (AnalysisException, ParseException) as error:
        raise ValueError(f"bad filter expression: {error}") from error
