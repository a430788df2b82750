"""Encoding and dialect of every file of delimited text, judged from all its lines in one distributed scan."""

from __future__ import annotations

import codecs
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..plans.layout import durable

DELIMITERS = [",", ";", "\t", "|"]
QUOTES = ['"', "'"]

# Byte-order marks; the four-byte ones come first because they begin like the two-byte ones.
_MARKS = [("utf-8-sig", codecs.BOM_UTF8), ("utf-32", codecs.BOM_UTF32_LE), ("utf-32", codecs.BOM_UTF32_BE),
          ("utf-16", codecs.BOM_UTF16_LE), ("utf-16", codecs.BOM_UTF16_BE)]


@dataclass(frozen=True)
class Dialect:
    encoding: str
    delimiter: str
    quote: str
    multiline: bool = False
    header: bytes = b""


def raw_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value (bytes up to a line feed, as they are), file, start (of the split that the line is in), place (rises within a split)."""
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


def unquoted(value: Column, quote: str) -> Column:
    """The text without its quoted parts; a part that is not closed goes on to the end."""
    return F.when(F.contains(value, F.lit(quote)), F.regexp_replace(value, f"{quote}[^{quote}]*({quote}|$)", "")).otherwise(value)


def occurrences(value: Column, sign: str) -> Column:
    return F.octet_length(value) - F.octet_length(F.replace(value, F.lit(sign), F.lit("")))


def survey(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """What a dialect is judged by: a row per file and split, from one scan, kept in the checkpoint folder.

    first (line of the file), kinds (of lines: 0 UTF-8, 1 not, 2 not and with bytes 0x80 to 0x9f), and for either quote sign: odd (lines with an odd
    number), cells (quoted cells seen), lines (others, not blank), and sums and squared sums of each delimiter outside quotes.
    """
    value = F.col("value")
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    kind = F.when(F.is_valid_utf8(value), 0).when(latin.rlike("[\u0080-\u009f]"), 2).otherwise(1)
    found = [F.min_by(value, "place").alias("first"), F.collect_set(kind).alias("kinds")]
    for i, quote in enumerate(QUOTES):
        odd = occurrences(value, quote) % 2 == 1
        edge = f"(^|[{''.join(DELIMITERS)}]){quote}" + (f"[^{quote}]*{quote}([{''.join(DELIMITERS)}]|\\r?$)" if i else "")
        plain = ~odd & (F.trim(value) != "")
        count = lambda test: F.sum(F.when(test, 1).otherwise(0))
        found += [count(odd).alias(f"odd{i}"), count(F.contains(value, F.lit(quote)) & value.rlike(edge)).alias(f"cells{i}"), count(plain).alias(f"lines{i}")]
        for k, delimiter in enumerate(DELIMITERS):
            n = F.when(plain, occurrences(unquoted(value, quote), delimiter)).cast("long")
            found += [F.sum(n).alias(f"sum{i}{k}"), F.sum(n * n).alias(f"square{i}{k}")]
    return durable(raw_lines(spark, path).groupBy("file", "start").agg(*found))


def _judged(row: Row) -> Dialect:
    """The quote is the double one unless more cells stand in single ones. The delimiter is the one whose number in a line differs least
    from that in the first line, relative to it; of equals, the one with more fields, then the earlier in the list."""
    head = bytes(row["header"] or b"")
    kinds = {k for some in row["kinds"] for k in some}
    encoding = next((name for name, mark in _MARKS if head.startswith(mark)), None)
    encoding = encoding or ("windows-1252" if 2 in kinds else "iso-8859-1" if 1 in kinds else "utf-8")
    i = int(row["cells1"] > row["cells0"])
    best, delimiter = (float("inf"), 0), ","
    for k, sign in enumerate(DELIMITERS):
        h, n = row[f"head{i}{k}"] or 0, row[f"lines{i}"]
        if h:
            away = ((row[f"square{i}{k}"] or 0) - 2 * h * (row[f"sum{i}{k}"] or 0) + n * h * h) / (max(n, 1) * h * h)
            if (away, -h) < best:
                best, delimiter = (away, -h), sign
    return Dialect(encoding, delimiter, QUOTES[i], row[f"odd{i}"] > 0, head)


def file_dialects(splits: DataFrame) -> dict[str, Dialect]:
    """The dialect of each file of a survey. The driver gets a row per file, as it does for the list of files."""
    first = F.max(F.when(F.col("start") == 0, F.col("first")))
    sums = [F.sum(c).alias(c) for c in splits.columns if c not in ("file", "start", "first", "kinds")]
    files = splits.groupBy("file").agg(first.alias("first"), F.collect_set("kinds").alias("kinds"), *sums)
    heads = [occurrences(unquoted(F.col("first"), q), d).alias(f"head{i}{k}") for i, q in enumerate(QUOTES) for k, d in enumerate(DELIMITERS)]
    return {r["file"]: _judged(r) for r in files.select("*", F.col("first").cast("binary").alias("header"), *heads).drop("first").collect()}
