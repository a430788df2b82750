"""Date and time helpers on zone-less timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Format directives and the pattern letters that mean the same in Spark.
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a",
    "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "h": "MMM", "j": "DDD", "f": "SSSSSS",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "%": "%", "e": "d", "z": "xx",
}
# Duration units; calendar ones in months, the others in microseconds.
_MONTHS = {"y": 12, "q": 3, "mo": 1}
_MICROS = {"w": 604_800_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000,
           "ms": 1_000, "us": 1}
_DURATION = re.compile(r"(\d+)(mo|ms|us|y|q|w|d|h|m|s)")
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_FIRST_MONDAY = "timestamp_ntz'1970-01-05 00:00:00'"


def spark_pattern(fmt: str, parsing: bool = False) -> str:
    """Translate ``%``-directives into a Spark datetime pattern; other letters are quoted."""
    out, quoted_run = [], ""

    def flush():
        nonlocal quoted_run
        if quoted_run:
            out.append("'" + quoted_run.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]#{}]", quoted_run)
                       else quoted_run)
            quoted_run = ""

    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            letter = fmt[i + 1]
            if letter not in _DIRECTIVES:
                raise ValueError(f"unsupported directive %{letter}")
            if letter == "%":
                quoted_run += "%"
            else:
                flush()
                pattern = _DIRECTIVES[letter]
                out.append({"dd": "d", "MM": "M"}.get(pattern, pattern) if parsing else pattern)
            i += 2
        else:
            quoted_run += fmt[i]
            i += 1
    flush()
    return "".join(out)


def strftime(col: Column, fmt: str) -> Column:
    return F.date_format(col, spark_pattern(fmt))


def to_date_text(col: Column, fmt: str = "%Y-%m-%d") -> Column:
    """Parse a date; null when it does not fit."""
    return F.try_to_timestamp(col, F.lit(spark_pattern(fmt, parsing=True))).cast("date")


def to_datetime_text(col: Column, fmt: str) -> Column:
    """Parse a zone-less timestamp; null when it does not fit."""
    return F.try_to_timestamp(col, F.lit(spark_pattern(fmt, parsing=True))).cast("timestamp_ntz")


def date_part_us(col: Column) -> Column:
    """Microseconds after the full second."""
    return F.date_format(col, "SSSSSS").cast("int")


def date_part_ns(col: Column) -> Column:
    return date_part_us(col) * 1000


def iso_weekday(col: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(col) + 1


def _parse(every: str) -> tuple[int, int]:
    """``(months, microseconds)`` of a duration such as ``1mo`` or ``1d12h``; a leading minus negates it."""
    text = every.strip()
    sign = -1 if text.startswith("-") else 1
    body = text.lstrip("-")
    parts = _DURATION.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {every!r}")
    months = sum(int(n) * _MONTHS[u] for n, u in parts if u in _MONTHS)
    micros = sum(int(n) * _MICROS[u] for n, u in parts if u in _MICROS)
    return sign * months, sign * micros


def offset_by(col: Column, by: str) -> Column:
    """Shift by a duration; months clamp to the last day of a shorter month."""
    months, micros = _parse(by)
    out = col.cast("timestamp_ntz")
    if months:
        out = out + F.make_ym_interval(F.lit(0), F.lit(months))
    if micros:
        out = F.timestamp_add("MICROSECOND", F.lit(micros), out)
    return out


def truncate(col: Column, every: str) -> Column:
    """Start of the ``every``-long period holding the value (weeks start on Monday)."""
    months, micros = _parse(every)
    if months < 0 or micros < 0 or (months and micros) or not (months or micros):
        raise ValueError(f"cannot truncate to {every!r}")
    ts = col.cast("timestamp_ntz")
    if months:
        index = F.year(ts) * 12 + F.month(ts) - 1
        start = index - F.pmod(index, F.lit(months))
        return F.make_date(F.floor(start / 12).cast("int"), F.pmod(start, F.lit(12)) + 1, F.lit(1)).cast("timestamp_ntz")
    origin = F.expr(_FIRST_MONDAY if every.strip().endswith("w") else _EPOCH)
    elapsed = F.timestamp_diff("MICROSECOND", origin, ts)
    return F.timestamp_add("MICROSECOND", elapsed - F.pmod(elapsed, F.lit(micros)), origin)


def round_to(col: Column, every: str) -> Column:
    """Nearest period start; halfway goes up."""
    ts = col.cast("timestamp_ntz")
    low = truncate(ts, every)
    high = offset_by(low, every)
    before = F.timestamp_diff("MICROSECOND", low, ts)
    after = F.timestamp_diff("MICROSECOND", ts, high)
    return F.when(before >= after, high).otherwise(low)


def combine(day: Column, time_text: Column) -> Column:
    """Date of ``day`` with the clock time of ``time_text`` (``HH:mm:ss``)."""
    return F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), time_text).try_cast("timestamp_ntz")
