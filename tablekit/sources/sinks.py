"""Writers. The row id never leaves the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import NUMERIC_TYPES
from ..plans.layout import ROW_ID, quoted


def without_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    without_row_id(df).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    without_row_id(df).write.mode(mode).csv(path, header=True, escape='"')


def write_csv_like_source(df: DataFrame, path: str, sep: str = ",", quote: str = '"', mode: str = "errorifexists") -> None:
    """CSV with a chosen delimiter and quote where exactly the non-numeric cells are quoted.

    Spark's own writer can quote all cells or only those that need it, so the lines are built as one
    expression. The header goes before the first row of every part file, as Spark's writer does it; a table without rows has
    one file with the header alone.
    """
    out = without_row_id(df)
    wrap = lambda text: F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    cells = []
    for f in out.schema.fields:
        text = F.col(quoted(f.name)).cast("string")
        cells.append(F.coalesce(text if isinstance(f.dataType, NUMERIC_TYPES) else wrap(text), F.lit("")))
    header = sep.join(quote + c.replace(quote, quote * 2) + quote for c in out.columns)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.concat_ws(sep, *cells)
    lines = out.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    if out.isEmpty():
        lines = out.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
    lines.write.mode(mode).text(path)
