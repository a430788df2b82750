"""Delimited text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.layout import PLACE, quoted
from .records import quoted_records
from .sniff import Dialect, file_dialects, occurrences, raw_lines, survey, unquoted

# The only bytes where windows-1252 and iso-8859-1 differ, paired by rule.
_CP1252 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_CP1252 = {k: v for k, v in _CP1252.items() if v}

_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf8": "UTF-8", "windows-1252": "ISO-8859-1",
                "cp1252": "ISO-8859-1", "ascii": "US-ASCII"}
_AUTO = "auto"


def _spark_name(encoding: str) -> str:
    return _SPARK_NAMES.get(encoding.lower(), encoding)


def _is_wide(encoding: str) -> bool:
    return encoding.lower().startswith(("utf-16", "utf-32"))


def _groups(spark: SparkSession, path: str | Sequence[str], sep: str, quote: str, encoding: str, multiline: bool) -> list[tuple[Dialect, list[str]]]:
    """The files of each dialect and header, by the first of them."""
    groups: dict[Dialect, list[str]] = {}
    for file, seen in sorted(file_dialects(survey(spark, path)).items()):
        seen = replace(seen, **{k: v for k, v in (("delimiter", sep), ("quote", quote), ("encoding", encoding)) if v != _AUTO})
        groups.setdefault(replace(seen, multiline=seen.multiline or multiline), []).append(file)
    return list(groups.items())


def _decoded(value: Column, encoding: str) -> Column:
    return value.cast("string") if _spark_name(encoding) in ("UTF-8", "US-ASCII") else F.decode(value, _spark_name(encoding))


def _folder_value(file: Column, name: str) -> Column:
    """What a path says of a partition column."""
    found = F.regexp_extract(file, f"/{re.escape(name)}=([^/]*)", 1)
    return F.when(found != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def _read_group(spark: SparkSession, path: str | Sequence[str], found: Dialect, header: bool, infer_types: bool, placed: bool, base: str | None) -> DataFrame:
    """Files of one dialect (and one header)."""
    wide = _is_wide(found.encoding)
    cells = {"sep": found.delimiter, "quote": found.quote, "escape": found.quote}
    reader = spark.read.options(header=header, encoding=_spark_name(found.encoding), **cells, **({"basePath": base} if base else {}))
    if found.multiline and not wide and not infer_types:
        folders = (spark.read.option("basePath", base) if base else spark.read).text(path).schema.fields[1:]
        columns = [c for c in reader.csv(path, multiLine=True).columns if c not in {f.name for f in folders}]  # reads the first record alone
        records = quoted_records(spark, path, found.delimiter, found.quote)
        if header:
            records = records.where("start > 0 or seq > 0")
        text = F.regexp_replace(_decoded(F.col("value"), found.encoding), "\r$", "")
        row = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(columns))), {**cells, "multiLine": "true"})
        hidden = [F.col("file").alias(PLACE[0]), F.col("start").alias(PLACE[1]), F.col("seq").alias(PLACE[2])] * placed
        given = [_folder_value(F.col("file"), f.name).cast(f.dataType).alias(f.name) for f in folders]
        df = records.select(row.alias("row"), *hidden, *given).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)], *[F.col(quoted(f.name)) for f in folders], *PLACE[:3 * placed])
    else:
        df = reader.csv(path, inferSchema=infer_types, mode="PERMISSIVE", multiLine=found.multiline or wide)
        if placed:
            df = df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]), F.monotonically_increasing_id().alias(PLACE[2]))
    if found.encoding.lower() in ("windows-1252", "cp1252"):
        fix = lambda c: F.translate(F.col(quoted(c)), "".join(_CP1252), "".join(_CP1252.values()))
        titles = str.maketrans(_CP1252)
        df = df.select(*[(fix(f.name) if f.dataType.simpleString() == "string" and f.name not in PLACE else F.col(quoted(f.name)))
                         .alias(f.name.translate(titles)) for f in df.schema.fields])
    return df


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = _AUTO, quote: str = _AUTO, encoding: str = _AUTO, header: bool = True,
                   infer_types: bool = False, multiline: bool = False, on_ragged: str = "keep", placed: bool = False) -> DataFrame:
    """Delimited text with all columns as strings; short rows are null-filled, extra cells dropped (`ragged_rows` counts both;
    with ``on_ragged="raise"`` they are an error that names the files).

    What is ``auto`` is told for each file from all its lines, in one scan. Files of one dialect and header are read
    together, and the groups united by column name, in file order. Quoted cells may hold line breaks: such files are read in splits as well, each split
    cutting its own records. windows-1252 is scanned as iso-8859-1 and its 27 differing characters are translated in place. UTF-16 and
    UTF-32 take one task per file, as do line breaks within cells with ``infer_types``; there Spark makes a break within a cell a line feed, elsewhere it stays
    as it is.
    """
    if on_ragged not in ("keep", "raise"):
        raise ValueError("on_ragged is keep or raise")
    if on_ragged == "raise":
        bad = ragged_rows(spark, path, sep, quote, encoding, header).where("short_rows + long_rows > 0").orderBy("file").limit(10).collect()
        if bad:
            raise ValueError("rows with too few or too many cells: " + "; ".join(f"{r['file']}: {r['short_rows']} short, {r['long_rows']} long" for r in bad))
    if _AUTO not in (sep, quote, encoding) and not multiline:
        return _read_group(spark, path, Dialect(encoding, sep, quote), header, infer_types, placed, None)
    groups = _groups(spark, path, sep, quote, encoding, multiline)
    if len(groups) < 2:
        found = groups[0][0] if groups else Dialect("utf-8", ",", '"')
        return _read_group(spark, path, found, header, infer_types, placed, None)
    base = path if isinstance(path, str) and not any(c in path for c in "*?[{") else None
    parts = [_read_group(spark, files, found, header, infer_types, placed, base) for found, files in groups]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(quoted(c)) for c in out.columns if c not in PLACE], *PLACE[:3 * placed])


def ragged_rows(spark: SparkSession, path: str | Sequence[str], sep: str = _AUTO, quote: str = _AUTO, encoding: str = _AUTO, header: bool = True) -> DataFrame:
    """file, rows, short_rows, long_rows: rows with fewer or more cells than the file's first record. Blank lines are not rows."""
    groups = _groups(spark, path, sep, quote, encoding, False)
    parts = []
    for found, files in groups:
        if _is_wide(found.encoding):
            lines = spark.read.option("encoding", found.encoding).option("lineSep", "\n").text(files).select("value", F.col("_metadata.file_path").alias("file"))
        elif found.multiline:
            lines = quoted_records(spark, files, found.delimiter, found.quote).select(F.col("value").cast("string").alias("value"), "file")
        else:
            lines = raw_lines(spark, files).select("value", "file")
        lines = lines.where(F.trim(F.regexp_replace("value", "\r$", "")) != "")
        fields = occurrences(unquoted(F.col("value"), found.quote), found.delimiter) + 1
        usual = _columns(spark, files, found, header)
        count = lambda test: F.sum(F.when(test, 1).otherwise(0)).alias
        parts.append(lines.select("file", fields.alias("n")).groupBy("file").agg((F.count("*") - int(header)).alias("rows"), count(F.col("n") < usual)("short_rows"), count(F.col("n") > usual)("long_rows")))
    shape = "file string, rows long, short_rows long, long_rows long"
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], shape)


def _columns(spark: SparkSession, files: list[str], found: Dialect, header: bool) -> int:
    return len(spark.read.csv(files[:1], sep=found.delimiter, quote=found.quote, escape=found.quote, header=header, encoding=_spark_name(found.encoding), multiLine=found.multiline or _is_wide(found.encoding)).columns)


def file_facts(spark: SparkSession, path: str | Sequence[str], **given: str) -> DataFrame:
    """file, encoding, delimiter, quote, line_breaks (within cells) of each delimited file."""
    groups = _groups(spark, path, given.get("sep", _AUTO), given.get("quote", _AUTO), given.get("encoding", _AUTO), False)
    found = [(file, d.encoding, d.delimiter, d.quote, d.multiline) for d, files in groups for file in files]
    return spark.createDataFrame(found, "file string, encoding string, delimiter string, quote string, line_breaks boolean")


def read_quick_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated text with inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True, escape='"')
