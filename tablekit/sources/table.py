"""One entry point for every input format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.layout import PLACE, ROW_ID, first_rows, numbered_by_place, quoted, with_row_id
from .archives import read_npz, read_workbook
from .text import file_facts, read_delimited

# File endings and the format they stand for.
FORMATS = {"csv": "text", "tsv": "text", "txt": "text", "dat": "text", "parquet": "parquet", "json": "json",
           "jsonl": "ndjson", "ndjson": "ndjson", "xlsx": "workbook", "xlsm": "workbook", "npz": "npz"}


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; pass format=")
    return FORMATS[ending]


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, format: str | None = None, columns: Sequence[str] | None = None,
               n_rows: int | None = None, strings: bool = False, row_id: bool = False, **options) -> DataFrame:
    """Read any supported file or folder; column choice and row cap reach the scan. The cap takes the first rows in file order, and row
    ids count in that order, without a copy of the rows.

    ``options`` go to the format's reader: ``sep``, ``quote``, ``encoding`` for text, ``sheet`` for
    workbooks, ``array`` for NumPy archives.
    """
    kind = format or format_of(path)
    readers = {
        "text": lambda: read_delimited(spark, path, placed=row_id or n_rows is not None, **options),
        "parquet": lambda: spark.read.parquet(path),
        "json": lambda: spark.read.json(path, multiLine=True),
        "ndjson": lambda: spark.read.json(path),
        "workbook": lambda: read_workbook(spark, path, **options),
        "npz": lambda: read_npz(spark, path, **options),
    }
    if kind not in readers:
        raise ValueError(f"unknown format {kind!r}")
    df = readers[kind]()
    if columns is not None:
        df = df.select(*[F.col(quoted(c)) for c in [*columns, *PLACE] if c in columns or c in df.columns])
    if n_rows is not None:
        df = first_rows(df, n_rows)
    place = [c for c in PLACE if c in df.columns]
    if strings:
        df = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns if c not in place], *place)
    if not row_id:
        return df.drop(*place)
    if place and n_rows is not None:  # few rows, in one task already
        return df.withColumn(ROW_ID, (F.row_number().over(Window.orderBy(*place)) - 1).cast("bigint")).drop(*place)
    return numbered_by_place(df) if place else with_row_id(df)


def source_facts(df: DataFrame) -> DataFrame:
    """Rows, files and bytes behind a file-based table: one row, from file metadata columns only."""
    per_file = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    files = per_file.groupBy("f").agg(F.first("s").alias("s"), F.count("*").alias("n"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                     F.count("*").alias("files"), (F.coalesce(F.sum("s"), F.lit(0)) / 1048576.0).alias("size_mb"))


def load_facts(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """What was loaded, a row per file: file, format, rows, columns, size_mb; for delimited text also encoding, delimiter, quote and
    line_breaks (whether quoted cells hold some), null for other formats."""
    kind = format or format_of(path)
    none = {c: F.lit(None).cast("string") for c in ("encoding", "delimiter", "quote")} | {"line_breaks": F.lit(None).cast("boolean")}
    if kind == "text":
        df = read_delimited(spark, path, placed=True, **options)
        sizes = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
        counts = df.groupBy(F.col(PLACE[0]).alias("file")).agg(F.count("*").alias("rows"))
        told = file_facts(spark, path, **{k: v for k, v in options.items() if k in ("sep", "quote", "encoding")})
        found = sizes.join(counts, "file", "left").join(told, "file").withColumn("n", F.lit(len(df.columns) - len(PLACE)))
    elif kind in ("workbook", "npz"):
        raise ValueError("workbooks and archives are listed by list_sheets and list_arrays")
    else:
        df = read_table(spark, path, kind, **options)
        found = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows")).withColumns({**none, "n": F.lit(len(df.columns))})
    return found.select("file", F.lit(kind).alias("format"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.col("n").alias("columns"), (F.col("size") / 1048576.0).alias("size_mb"),
                        "encoding", "delimiter", "quote", "line_breaks")
